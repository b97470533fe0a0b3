"""SURVEY §5 invariants on the smallest driver tables."""

import pytest
from pyspark.sql import functions as F

from recsift.operators import interactions as I
from recsift.operators import sequences as sq
from recsift.plans.q_interactions import _thresholds
from recsift.sources import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ix(spark):
    return views.interactions(spark, SF).cache()


def test_dedup_idempotent_on_data(ix):
    assert I.dedup_keep_earliest(ix).exceptAll(ix).count() == 0
    assert ix.count() == 5382


def test_last_out_invariants(ix):
    out = I.last_out(ix)
    per = out.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("t"),
        F.sum((F.col("split") == "valid").cast("int")).alias("v"), F.sum((F.col("split") == "train").cast("int")).alias("r"))
    for r in per.collect():
        assert r.t == 1 and r.v == (1 if r.n >= 2 else 0) and r.r == max(0, r.n - 2)
    assert out.drop("split").exceptAll(ix).count() == 0 and out.count() == ix.count()


def test_timestamp_split_union_is_input(spark, ix):
    t_valid, t_test = _thresholds(spark, SF)
    assert (t_valid, t_test) == (950054400006, 974851200002)
    out = I.timestamp_split(ix, t_valid, t_test)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 4386, "valid": 490, "test": 506}


def test_id_maps_contiguous_bijective_ordered(spark, ix):
    t_valid, t_test = _thresholds(spark, SF)
    seqs = sq.prepare_sequences(ix, views.items(spark, SF), t_valid, t_test, 50)
    assert seqs.count() == 4731
    users, items = sq.remap_ids(seqs)
    for m, tok, idc in ((users, "user_id", "uid"), (items, "parent_asin", "iid")):
        rows = m.collect()
        ids = sorted(r[idc] for r in rows)
        assert ids == list(range(1, len(rows) + 1))
        assert len({r[tok] for r in rows}) == len(rows)
    # a user's id order follows its first appearance (split, user, time)
    so = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    first = seqs.groupBy("user_id").agg(F.min(F.struct(so.alias("s"), "user_id", "timestamp")).alias("k"))
    ordered = [r.uid for r in first.join(users, "user_id").orderBy("k").collect()]
    assert ordered == sorted(ordered)


def test_kcore_known_counts(ix):
    assert I.k_core(ix, 15).edges.count() == 5342
    res = I.k_core(ix, 22)
    assert res.edges.count() == 0 and len(res.trace) == 10
