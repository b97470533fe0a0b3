"""Hard negatives over the inverted multi-index against brute force."""

import math
import random

import numpy as np
import pytest

from recsift.llm import hardneg
from pyspark.sql import functions as F


def brute(rows, every=5, n_pos=5, n_neg=5):
    usable = [(i, lab, tuple(float(x) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v
              and all(x is not None and math.isfinite(x) for x in v)]
    sizes = {}
    for _, _, v in usable:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    dim = min(sizes, key=lambda d: (-sizes[d], d)) if sizes else 0
    one = {}
    for i, lab, v in usable:
        if len(v) == dim:
            one[i] = min(one.get(i, (lab, v)), (lab, v))
    ints = {i: (lab, [math.floor(256 * x) for x in v]) for i, (lab, v) in one.items()}
    out = []
    for a, (la, va) in ints.items():
        if a % every:
            continue
        score = {o: sum(x * y for x, y in zip(va, v)) for o, (_, v) in ints.items() if o != a}
        order = sorted(score, key=lambda o: (-score[o], o))
        for p in [o for o in order if ints[o][0] == la][:n_pos]:
            ps = score[p]
            neg = [o for o in order if ints[o][0] != la and 80 * ps <= 100 * score[o] <= 100 * ps][:n_neg]
            out += [(a, p, r + 1, o, ps, score[o]) for r, o in enumerate(neg)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, lab, v, 1, 2.0) for i, lab, v in rows],
                                 "vec_id long, label int, vec array<float>, cell int, score double")


def f32(rng, n, centre=None):
    return [float(np.float32((c if centre else 0.0) + rng.gauss(0, 0.3 if centre else 1.0) / 4)) for c in (centre or [0.0] * n)]


@pytest.mark.parametrize("kind", ["plain", "clustered", "ties"])
def test_against_brute_force(spark, monkeypatch, kind):
    for name, value in (("PART_ROWS", 16), ("ANCHOR_ROWS", 7), ("FIRST_ROWS", 20), ("GROWTH", 3)):
        monkeypatch.setattr(hardneg, name, value)
    rng = random.Random(kind)
    centres = [[rng.choice([-1.0, 1.0]) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(-30, 220):
        label = rng.randrange(3)
        if kind == "plain":
            v = f32(rng, 6)
        elif kind == "clustered":
            v = f32(rng, 6, centres[(label + (rng.random() < 0.3)) % 5])
        else:
            v = [float(rng.randrange(-1, 2)) for _ in range(6)]
        rows.append((i, label, v))
    rows += [(300, None, [1.0] * 6), (305, 1, None), (310, 1, []), (315, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
             (320, 2, [math.nan] * 6), (325, 2, [math.inf] * 6), (330, 1, [1.0] * 3), (None, 1, [1.0] * 6),
             rows[40], rows[40], (rows[35][0], 2, rows[35][2]), (345, 9, [0.5] * 6), (350, 1, [0.0] * 6)]
    got = hardneg.mine(table(spark, rows), F.col("vec_id") % 5 == 0, codes=4).collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == want and len(want) > 50


def test_heap_order_and_bounds():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 5))
    books = (hardneg.fit_codebook(m[:, :2], 6), hardneg.fit_codebook(m[:, 2:], 6))
    near = [hardneg._nearest(h, b) for h, b in zip((m[:, :2], m[:, 2:]), books)]
    radii = [np.array([max((np.linalg.norm(h[i] - b[c]) for i in np.flatnonzero(n == c)), default=0.0) for c in range(len(b))])
             for h, b, n in zip((m[:, :2], m[:, 2:]), books, near)]
    sizes = {}
    for c in (near[0] * 6 + near[1]).tolist():
        sizes[c] = sizes.get(c, 0) + 1
    for q in m[:20]:
        order = list(hardneg.multi_sequence(*hardneg.half_bounds(q, books, radii)))
        assert len(order) == 36 and len({c for c, _ in order}) == 36
        bounds = [b for _, b in order]
        assert bounds == sorted(bounds, reverse=True)
        bound = dict(order)
        assert all(m[i] @ q <= bound[int(near[0][i] * 6 + near[1][i])] for i in range(200))
        done, seen = 0, []
        while True:
            cells, done, rest = hardneg.next_cells(q, books, radii, sizes, done, 30)
            seen += cells
            if rest == -math.inf:
                break
        assert seen == [c for c, _ in order if c in sizes]


def test_small_tables(spark):
    empty = table(spark, [(1, 1, [1.0])]).limit(0)
    assert hardneg.mine(empty, F.col("vec_id") % 5 == 0).count() == 0
    assert hardneg.mine(table(spark, [(0, 1, [1.0, 2.0])]), F.col("vec_id") % 5 == 0).count() == 0
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [0.9])]
    assert sorted(map(tuple, hardneg.mine(table(spark, rows), F.col("vec_id") % 5 == 0).collect())) == brute(rows)
