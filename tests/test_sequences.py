import numpy as np
from pyspark.sql import functions as F

from recsift.operators import sequences as sq
from recsift.operators.interactions import history_text


def test_history_filter_and_truncation(spark, ix):
    # u: target unknown → dropped; v: all history unknown → dropped; w: mixed, order kept
    data = [("u", "k1", 1.0, 1), ("u", "x", 1.0, 2),
            ("v", "x", 1.0, 1), ("v", "y", 1.0, 2), ("v", "k1", 1.0, 3),
            ("w", "k1", 1.0, 1), ("w", "x", 1.0, 2), ("w", "k2", 1.0, 3), ("w", "k3", 1.0, 4)]
    items = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "parent_asin string")
    out = sq.prepare_sequences(ix(data), items, 100, 200, max_len=50)
    got = sorted((r.user_id, r.parent_asin, r.h) for r in out.withColumn("h", history_text("history")).collect())
    assert got == [("w", "k2", "k1"), ("w", "k3", "k1 k2")]
    short = sq.prepare_sequences(ix(data), items, 100, 200, max_len=1)
    assert {r.parent_asin: r.history for r in short.collect()}["k3"] == ["k2"]


def test_first_appearance_ids(spark):
    seqs = spark.createDataFrame([("u", "x", 5, ["y", "z"], "train"), ("v", "z", 6, ["w"], "test")],
                                 "user_id string, parent_asin string, timestamp long, history array<string>, split string")
    users, items = sq.remap_ids(seqs)
    assert {r.parent_asin: r.iid for r in items.collect()} == {"x": 1, "y": 2, "z": 3, "w": 4}
    assert {r.user_id: r.uid for r in users.collect()} == {"u": 1, "v": 2}


def test_interaction_count_rule(spark):
    seqs = spark.createDataFrame([("u", "a", 1, ["x"], "train"), ("u", "b", 2, ["x", "y", "z"], "train")],
                                 "user_id string, parent_asin string, timestamp long, history array<string>, split string")
    users, items = sq.remap_ids(seqs)
    text = spark.createDataFrame([(t, "m" * 4) for t in "abxyz"], "parent_asin string, cleaned_metadata string")
    got = {r.metric: r.value for r in sq.dataset_stats(seqs, users, items, text).collect()}
    assert got["n_interactions_train"] == 3.0 and got["n_interactions_total"] == 3.0
    assert got["avg_history_length"] == 2.0 and got["avg_metadata_chars"] == 4.0


def test_first_appearances_are_combined_per_user_without_sorting(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(rng.integers(0, 30)), int(t) if t else None, [int(x) for x in rng.integers(0, 30, rng.integers(1, 5))],
             ["train", "valid", "test"][int(rng.integers(0, 3))]) for u in range(12) for t in rng.integers(0, 4, 6)]
    schema = "user_id long, parent_asin long, timestamp long, history array<long>, split string"
    order = {"train": 0, "valid": 1, "test": 2}
    first, firstu = {}, {}
    for u, i, t, h, sp in rows:
        for p, tok in enumerate([i, *h]):
            key = (order[sp], u, -1 if t is None else t, p)
            first[tok] = min(first.get(tok, key), key)
        key = (order[sp], u, -1 if t is None else t)
        firstu[u] = min(firstu.get(u, key), key)
    want = {tok: n for n, (tok, _) in enumerate(sorted(first.items(), key=lambda x: (x[1], x[0])), 1)}
    wantu = {u: n for n, (u, _) in enumerate(sorted(firstu.items(), key=lambda x: (x[1], x[0])), 1)}
    wide = [(u, i, None if t is None else t * (1 << 61), h, sp) for u, i, t, h, sp in rows]      # no room in the long
    for data in (rows, wide):
        seqs = spark.createDataFrame(data, schema)
        assert {r.parent_asin: r.iid for r in sq.remap_items(seqs).collect()} == want
        assert {r.user_id: r.uid for r in sq.remap_users(seqs).collect()} == wantu
    tokens = F.concat(F.array("parent_asin"), "history")
    plan = sq._first_keys(spark.createDataFrame(rows, schema), "user_id", "timestamp", tokens)._jdf.queryExecution().executedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate(" in line]
    assert "HashAggregate(" in aggregates[-1] and "SortAggregate(" not in aggregates[-1]     # the one next to the rows


def test_process_histories_in_place_equals_joins(spark):
    rng = np.random.default_rng(5)
    rows = [(r, f"i{rng.integers(0, 12)}" if r % 11 else None, None if r % 7 == 0 else
             [None if x == 0 else f"i{x}" for x in rng.integers(0, 12, rng.integers(0, 9))]) for r in range(150)]
    df = spark.createDataFrame(rows, "user_id long, parent_asin string, history array<string>").repartition(3)
    items = spark.createDataFrame([(f"i{x}",) for x in range(1, 8)] + [(None,), ("i3",)], "parent_asin string")
    known = {f"i{x}" for x in range(1, 8)}
    want = {r: [x for x in h if x in known][-3:] for r, t, h in rows if t in known and h and any(x in known for x in h)}
    here = sq.process_histories(df, items, 3)
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert here.columns == df.columns
    assert {r.user_id: r.history for r in here.collect()} == want
    assert {r.user_id: r.history for r in sq.process_histories(df, items, 3, known_broadcast=2).collect()} == want
