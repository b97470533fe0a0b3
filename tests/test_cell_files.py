"""a cell search hands on bounded batches, and no query's vector is repeated for the cells it probes."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from recsift.operators import dense as dn


def test_probed_cells_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(dn, "NEAREST_ROWS", 500, raising=False)
    rng = np.random.default_rng(3)
    cents, vecs = rng.normal(size=(50, 4)), rng.normal(size=(400, 4))
    batch = pd.DataFrame({"qid": range(400), "_q": list(vecs)})
    out = list(dn._nearest_cells(SimpleNamespace(value=cents), "_q", 50, ["qid", "_q"])(iter([batch, batch.iloc[:0]])))
    assert max(map(len, out)) <= 500 and sum(map(len, out)) == 400 * 50
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = np.argsort(-(unit @ cents.T), axis=1, kind="stable")
    assert (pd.concat(out)["cell"].to_numpy().reshape(400, 50) == want).all()


@pytest.mark.parametrize("probe", [3, 7])
@pytest.mark.parametrize("threshold", [None, 0.2])
def test_cell_search_in_small_files(spark, monkeypatch, probe, threshold):
    monkeypatch.setattr(dn, "SCORE_ITEMS", 9)
    monkeypatch.setattr(dn, "FIRST_ITEMS", 2)
    monkeypatch.setattr(dn, "SCORE_ROWS", 8)
    rng = np.random.default_rng(4)
    iv = rng.integers(-2, 3, size=(150, 3)).astype(float)      # many equal scores, some zero vectors
    qv = rng.integers(-2, 3, size=(40, 3)).astype(float)
    cents = rng.normal(size=(7, 3))
    cents /= np.linalg.norm(cents, axis=1, keepdims=True)
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=m.any(axis=1)[:, None])
    iu, qu = unit(iv), unit(qv)
    cell = np.argsort(-(iu @ cents.T), axis=1, kind="stable")[:, 0]
    cell[::2] = 2                                               # a crowded cell
    assign = spark.createDataFrame([(f"i{j:03d}", iu[j].tolist(), int(cell[j])) for j in range(150)], "item_id string, _u array<double>, cell int")
    queries = spark.createDataFrame([(q, qv[q].tolist()) for q in range(40)] + [(99, None)], "qid long, vec array<double>")
    want = set()
    for q in range(40):
        cells = set(np.argsort(-(qu[q] @ cents.T), kind="stable")[:probe].tolist())
        s = iu @ qu[q]
        ranked = sorted((-float(dn.round_half_up(s[j])), f"i{j:03d}") for j in range(150) if cell[j] in cells and (threshold is None or s[j] >= threshold))
        want |= {(q, i, -v, r + 1) for r, (v, i) in enumerate(ranked[:5])}
    for kw in ({}, {"file_bytes": 2000, "hold_bytes": 1500}, {"file_bytes": 500, "hold_bytes": 1}):
        got = dn.ivf_search(assign, cents, queries, 5, probe, threshold=threshold, **kw).collect()
        assert len(got) == len(want) and {(r.qid, r.item_id, r.score, r["rank"]) for r in got} == want
    assert dn.ivf_search(assign.filter("false"), cents, queries, 5, probe).count() == 0
