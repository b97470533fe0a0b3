"""item vectors of the next-item evaluation never pass the driver; tasks read them file by file."""

import numpy as np
import pytest

from recsift.operators import nextitem as ni


def _table(spark, n_items=120, n_rows=80):
    rng = np.random.default_rng(11)
    vecs = [(f"i{i}", rng.normal(size=4).tolist()) for i in range(n_items)]
    rows = [(r, [f"i{x}" for x in rng.integers(0, n_items + 20, 5)] + [None] * (r % 2), f"i{rng.integers(0, n_items)}") for r in range(n_rows)]
    rows += [(900, ["i1"], None), (901, None, "i2"), (902, [], "i2"), (903, ["none"], "i2"), (904, ["i1"], "none")]
    items = spark.createDataFrame(vecs + [("null", None)], "item_id string, vec array<double>")
    return vecs, rows, items, spark.createDataFrame(rows, "row_id long, history array<string>, target string")


def _want(vecs, rows, k=50):
    raw, unit = dict(vecs), {i: np.array(v) / np.linalg.norm(v) for i, v in vecs}
    want = {}
    for r, h, t in rows:
        known, want[r] = [raw[x] for x in h or [] if x in raw], None
        if known and t in raw:
            u = np.mean(known, axis=0)
            s = {i: round(float(u / np.linalg.norm(u) @ v), 6) for i, v in unit.items()}
            rank = 1 + sum(s[i] > s[t] or (s[i] == s[t] and i < t) for i in s if i != t)
            want[r] = rank if rank <= k else None
    return want


@pytest.mark.parametrize("sizes", [{}, {"pass_bytes": 4000, "means_bytes": 1000}, {"pass_bytes": 700, "means_bytes": 32, "row_block": 3, "item_block": 2}])
def test_no_item_vector_passes_the_driver(spark, monkeypatch, sizes):
    vecs, rows, items, df = _table(spark)
    want = _want(vecs, rows)

    def refuse(*a, **b):
        raise AssertionError("item vectors were collected by the driver")

    for name in ("toPandas", "toArrow"):         # counts and widths are collected, one row each
        monkeypatch.setattr(type(df), name, refuse)
    monkeypatch.setattr(spark.sparkContext, "broadcast", refuse)
    got = ni.evaluate_from_histories(df, items, **sizes)
    users = ni.history_mean_vectors(df, "row_id", "history", items.filter("vec is not null"), "item_id", "vec")
    general = ni.evaluate_next_item(users, items, df, **{"hold_bytes" if k == "means_bytes" else k: v for k, v in sizes.items()})
    monkeypatch.undo()
    assert {r["row_id"]: r["rank"] for r in got.collect()} == want
    assert {r["row_id"]: r["rank"] for r in general.collect()} == want


def test_files_are_bounded_and_whole(spark):
    vecs, _, items, _ = _table(spark)
    files, dim = ni._store_items(items, "item_id", "vec", 4000)
    held = [ni._load_items(f, "item_id", dim, False) for f in files]
    assert len(files) == 4 and max(v.nbytes for _, v in held) < 2 * 4000
    assert all((ids[1:] > ids[:-1]).all() for ids, _ in held)
    assert {i: v.tolist() for ids, vs in held for i, v in zip(ids, vs)} == dict(vecs)


def test_no_items_at_all(spark):
    _, _, items, df = _table(spark, 3, 4)
    got = ni.evaluate_from_histories(df, items.filter("false"))
    assert got.count() == 9 and got.filter("rank is not null").count() == 0
