import json
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from recsift.operators import interactions as I
from recsift.sources import readers as rd
from recsift.sources import writers as wr


def scratch():
    return tempfile.mkdtemp(prefix="recsift-test-")


def test_read_reviews_bad_lines(spark):
    d = scratch()
    lines = ['{"user_id": "u", "parent_asin": "a", "rating": 5, "sortTimestamp": 10}', "",
             "not json", '{"user_id": "u", "rating": 5, "sortTimestamp": 11}',
             '{"user_id": "v", "parent_asin": "b", "rating": "4", "sortTimestamp": "12"}']
    with open(os.path.join(d, "Beauty.json"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    good, bad = rd.read_reviews_jsonl(spark, d)
    assert sorted(tuple(r) for r in good.collect()) == [("u", "a", 5.0, 10), ("v", "b", 4.0, 12)]
    assert bad.count() == 2
    cat = rd.read_by_category(spark.read.text(d), "json").select("category").distinct().collect()
    assert [r.category for r in cat] == ["Beauty"]


def test_ratings_and_splits_round_trip(spark, ix):
    d = scratch()
    df = ix([("u", "a", 5.0, 1), ("u", "b", 4.0, 2), ("u", "c", 3.0, 3), ("v", "a", 1.0, 4)]).withColumn("category", F.lit("Toys"))
    path = wr.write_ratings(df, d, 0)
    back = rd.read_ratings_csv(spark, os.path.join(path, "category=Toys"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.select(*wr.RATING_COLS).collect())
    splits = I.last_out(back, history=True)
    out = wr.write_splits(splits, os.path.join(d, "split"), with_history=True)
    test = rd.read_split_csv(spark, os.path.join(out, "split=test"), with_history=True)
    got = {r.user_id: r.history for r in test.collect()}
    assert got == {"u": ["a", "b"], "v": []}


def test_inter_and_pairs_headers(spark):
    d = scratch()
    df = spark.createDataFrame([("u", "b", ["a"])], "user_id string, parent_asin string, history array<string>")
    wr.write_inter(df, os.path.join(d, "inter"))
    header = "user_id:token\titem_id_list:token_seq\titem_id:token"
    data = []
    for part in sorted(f for f in os.listdir(os.path.join(d, "inter")) if f.endswith(".csv")):
        with open(os.path.join(d, "inter", part)) as fh:
            lines = fh.read().splitlines()
        assert lines[0] == header  # every part file carries the typed header
        data += lines[1:]
    assert data == ["u\ta\tb"]


def test_text_pairs_short_and_long_rows(spark):
    d = scratch()
    p = os.path.join(d, "pairs.csv")
    with open(p, "w") as fh:
        fh.write("sent0,sent1\nonly one\nx,y\na,b,c\n")
    got = sorted((r.sent0, r.sent1) for r in rd.read_text_pairs(spark, p).collect())
    assert got == [("only one", None), ("x", "y")]


def test_vectors_round_trip(spark):
    d = os.path.join(scratch(), "vec")
    rnd = np.random.default_rng(0)
    m = rnd.normal(size=(37, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(37)], "id long, vec array<float>")
    wr.write_vectors_f32(df.orderBy(F.rand(1)), d, parts=4)
    raw = b"".join(open(os.path.join(d, f), "rb").read() for f in sorted(os.listdir(d)))
    assert np.array_equal(np.frombuffer(raw, "<f4").reshape(-1, 5), m)
    with open(os.path.join(d, "..", "all.f32"), "wb") as fh:
        fh.write(raw)
    back = rd.read_vectors_f32(spark, os.path.join(d, "..", "all.f32"), 5, first_id=1)
    got = {r.id: r.vec for r in back.collect()}
    assert np.allclose(got[1], m[0]) and np.allclose(got[37], m[36])


def test_item_pool_and_json_map(spark):
    d = scratch()
    with open(os.path.join(d, "pool.jsonl"), "w") as fh:
        fh.write(json.dumps({"item": "a", "category": "c", "metadata": "m"}) + "\n")
    assert rd.read_item_pool(spark, os.path.join(d, "pool.jsonl")).first().item_id == "a"
    with open(os.path.join(d, "map.json"), "w") as fh:
        fh.write(json.dumps({"a": "X", "b": "Unknown Y"}))
    got = {r.item_id: r.category for r in rd.read_json_map(spark, os.path.join(d, "map.json")).collect()}
    assert got == {"a": "X", "b": "Unknown Y"}


def test_metrics_report(spark):
    d = scratch()
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "metric string, value double")
    wr.write_metrics(df, os.path.join(d, "m"))
    part = [f for f in os.listdir(os.path.join(d, "m")) if f.startswith("part")][0]
    assert open(os.path.join(d, "m", part)).read().splitlines() == ["a = 1.0", "b = 2.0"]


def test_remaining_sinks_round_trip(spark):
    d = scratch()
    users = spark.createDataFrame([("u1", 1), ("u2", 2)], "user_id string, uid long")
    items = spark.createDataFrame([("a", 1)], "parent_asin string, iid long")
    wr.write_id_maps(users, items, os.path.join(d, "maps"))
    got = sorted(tuple(r) for r in spark.read.json(os.path.join(d, "maps")).select("kind", "token", "id").collect())
    assert got == [("item", "a", 1), ("user", "u1", 1), ("user", "u2", 2)]

    pairs = spark.createDataFrame([("good, with comma", "meta\twith tab")], "review string, meta string")
    wr.write_pairs_tsv(pairs, os.path.join(d, "pairs"))
    back = spark.read.option("sep", "\t").option("header", True).csv(os.path.join(d, "pairs"))
    assert [tuple(r) for r in back.collect()] == [("good, with comma", "meta\twith tab")]

    q = spark.createDataFrame([(0, "red shoes", "a")], "qid long, query string, item_id string")
    wr.write_queries_csv(q, os.path.join(d, "q"))
    assert [(r.qid, r.query, r.item_id) for r in rd.read_queries(spark, os.path.join(d, "q")).collect()] == [(0, "red shoes", "a")]

    pool = spark.createDataFrame([("a", "Toys", "m1"), ("b", "Toys", "m2")], "item_id string, category string, metadata string")
    wr.write_item_pool_jsonl(pool, os.path.join(d, "pool"))
    assert sorted(tuple(r) for r in rd.read_item_pool(spark, os.path.join(d, "pool")).collect()) == \
        [("a", "Toys", "m1"), ("b", "Toys", "m2")]


def test_item_pool_duplicate_raises(spark):
    import pytest

    d = scratch()
    with open(os.path.join(d, "pool.jsonl"), "w") as fh:
        fh.write(json.dumps({"item_id": "a", "category": "c", "metadata": "m"}) + "\n")
        fh.write(json.dumps({"item_id": "a", "category": "c", "metadata": "n"}) + "\n")
    with pytest.raises(ValueError):
        rd.read_item_pool(spark, os.path.join(d, "pool.jsonl"))


def test_lines_and_category_list(spark):
    d = scratch()
    with open(os.path.join(d, "s.txt"), "w") as fh:
        fh.write("  first sentence \t\nsecond\n")
    assert [r.text for r in rd.read_lines(spark, os.path.join(d, "s.txt")).collect()] == ["  first sentence", "second"]
    assert [r.category for r in rd.read_category_list(spark, os.path.join(d, "s.txt")).collect()] == ["first sentence", "second"]
