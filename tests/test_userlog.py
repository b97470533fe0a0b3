"""The stored interaction log against plain Python, with and without crowded users."""

import random

import pytest
from pyspark.sql import functions as F

from recsift.operators import interactions as ops
from recsift.operators import sequences as sq
from recsift.operators import userlog


def data(seed=2, n=900):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        u = "hot" if rng.random() < 0.4 else None if rng.random() < 0.05 else f"u{rng.randrange(25)}"
        rows.append((u, f"i{rng.randrange(120):03d}", float(rng.randrange(5)), rng.randrange(200), seq))
    return rows


def plain(rows):
    first = {}
    for r in rows:
        key = (r[0], r[1])
        if key not in first or (r[3], r[4]) < (first[key][3], first[key][4]):
            first[key] = r
    users = {}
    for r in sorted(first.values(), key=lambda r: (r[3], r[1])):
        users.setdefault(r[0], []).append(r)
    return users


@pytest.fixture(scope="module", params=[10_000, 40])
def log(request, spark):
    raw = spark.createDataFrame(data(), "user_id string, parent_asin string, rating double, timestamp long, seq long")
    return userlog.build_user_log(raw, part_rows=request.param)


def test_ranks_and_histories(log):
    users = plain(data())
    assert (log.crowded is None) == (log.part_rows > 1000)
    want = {(u, r[1]): (r[2], r[3], r[4], k + 1, len(rs), [x[1] for x in rs[:k]]) for u, rs in users.items() for k, r in enumerate(rs)}
    for n, got in ((None, userlog.full_history(log)), (None, userlog.full_history(log, block=7)), (5, userlog.bounded_history(log, 5)),
                   (0, userlog.bounded_history(log, 0))):
        found = {(r["user_id"], r["parent_asin"]): (r["rating"], r["timestamp"], r["seq"], r["rn"], r["n_user"], r["history"])
                 for r in got.collect()}
        cut = {k: (*v[:5], v[5] if n is None else v[5][len(v[5]) - min(n, len(v[5])):]) for k, v in want.items()}
        assert found == cut


def test_splits(log):
    users = plain(data())
    got = {(r["user_id"], r["parent_asin"]): r["split"] for r in userlog.last_out(log).collect()}
    assert got == {(u, r[1]): "test" if k == len(rs) - 1 else "valid" if k == len(rs) - 2 else "train"
                   for u, rs in users.items() for k, r in enumerate(rs)}
    got = {(r["user_id"], r["parent_asin"]): (r["split"], len(r["history"])) for r in userlog.timestamp_split(log, 100, 150, history=True).collect()}
    assert got == {(u, r[1]): ("test" if r[3] >= 150 else "valid" if r[3] >= 100 else "train", k)
                   for u, rs in users.items() for k, r in enumerate(rs)}


def test_sequences_from_the_log(spark, log):
    items = spark.createDataFrame([(f"i{i:03d}",) for i in range(0, 120, 2)], "parent_asin string")
    got = {(r["user_id"], r["parent_asin"]): (r["split"], r["history"]) for r in sq.prepare_from_log(log, items, 100, 150, 4).collect()}
    want = {}
    for u, rs in plain(data()).items():
        known = [r for r in rs if int(r[1][1:]) % 2 == 0]
        for k, r in enumerate(known):
            if k:
                want[u, r[1]] = ("test" if r[3] >= 150 else "valid" if r[3] >= 100 else "train", [x[1] for x in known[max(0, k - 4):k]])
    assert got == want


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_layout_is_shared(spark):
    raw = spark.createDataFrame(data(), "user_id string, parent_asin string, rating double, timestamp long, seq long")
    log = userlog.build_user_log(raw)
    # dedup, rank and history find their rows in place
    assert _exchanges(userlog.last_out(log, history=True)) == 0
    assert _exchanges(userlog.bounded_history(log, 5)) == 0


def test_prefix_groups_are_bounded_by_a_block(spark):
    """A user's list is put together per (user, block): no row of the refs repeats it."""
    raw = spark.createDataFrame([("u", i, 0.0, i, i) for i in range(500)], "user_id string, parent_asin long, rating double, timestamp long, seq long")
    log = userlog.build_user_log(raw, part_rows=50)
    rows, blocks = userlog.history_refs(log, block=20)
    assert "history" not in rows.columns and blocks.count() == 25
    assert blocks.agg(F.max(F.size("_items"))).first()[0] == 20 and rows.agg(F.max("_len")).first()[0] == 19
    got = userlog.expand_history(rows, blocks).select("rn", "history").collect()
    assert all(r["history"] == list(range(r["rn"] - 1)) for r in got) and len(got) == 500


def test_empty_log(spark):
    raw = spark.createDataFrame([], "user_id string, parent_asin string, rating double, timestamp long, seq long")
    log = userlog.build_user_log(raw)
    assert userlog.last_out(log, history=True).count() == 0


def test_counts_from_another_table(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1), (None, 5), (None, 4)], "k string, t long")
    more = df.unionByName(df)
    ranked, longest = ops.rank_within_stats(df, ["k"], ["t"], "rn", "n", hot_rows=40, count_from=more)
    assert longest == 60
    got = sorted(((r["k"] or ""), r["t"], r["rn"], r["n"]) for r in ranked.collect())
    assert got == sorted([("a", i, i + 1, 30) for i in range(30)] + [("b", 1, 1, 1), ("", 4, 1, 2), ("", 5, 2, 2)])


def test_quantiles_with_few_and_extreme_values(spark):
    import math

    rng = random.Random(4)
    for vals in ([5], [1, 1, 1, 2], [-(2**62), 2**62, 0], [rng.randrange(2**40) for _ in range(3000)], [7] * 1000 + [9]):
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v long")
        for p, got in ops.exact_quantiles(df, "v", (0.0, 0.1, 0.5, 0.8, 0.9, 1.0)):
            assert got == sorted(vals)[max(1, math.ceil(p * len(vals))) - 1]
    assert ops.exact_quantiles(df.limit(0), "v", (0.5,)) == [(0.5, None)]
