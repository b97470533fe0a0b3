from pyspark.sql import functions as F

from recsift.operators import sampling as sm


def test_negatives_distinct_and_bounded(spark):
    items = spark.createDataFrame([(i, "big" if i < 40 else "small") for i in range(43)], "item_id long, category string")
    pos = sm.category_positions(items, "item_id", "category", 5)
    q = spark.createDataFrame([(i, "big") for i in range(10)] + [(99, "small")], "qid long, category string")
    negs = sm.same_category_negatives(q, "qid", "category", pos, "item_id", 5, 5)
    per = {r.qid: r.c for r in negs.groupBy("qid").agg(F.countDistinct("neg_item").alias("c")).collect()}
    assert all(per[i] == 5 for i in range(10)) and per[99] == 3
    bad = negs.join(items.withColumnRenamed("item_id", "neg_item").withColumnRenamed("category", "c2"), "neg_item")
    assert bad.filter(F.col("c2") != F.col("category")).count() == 0


def test_hash_sample_is_stable(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    a = sorted(r.k for r in sm.hash_sample(df, ["k"], 10, 1).collect())
    b = sorted(r.k for r in sm.hash_sample(df.repartition(7), ["k"], 10, 1).collect())
    assert a == b and 120 < len(a) < 280


def test_sample_n_and_head_split(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    assert sm.sample_n(df, ["k"], 37, 2).count() == 37
    split = sm.head_percent_split(df, ["k"], 1.0)
    assert sorted(r.k for r in split.filter("split = 'validation'").collect()) == [0, 1, 2, 3, 4]
