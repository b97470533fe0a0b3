import numpy as np
from pyspark.sql import functions as F

from recsift.functions import text as tx
from recsift.functions import tokens as tk
from recsift.functions.hashing import hash32, sql_hash32
from recsift.operators import metrics as mt
from recsift.operators import pairs as pr


def test_number_text_and_file_name(spark):
    df = spark.createDataFrame([(4.5, "Arts Crafts and Sewing")], "x double, c string")
    r = df.select(tx.number_text("x").alias("n"), tx.category_file_name("c").alias("f")).first()
    assert (r.n, r.f) == ("4.5.", "Arts_Crafts_and_Sewing")


def test_truncate_pad_and_mask(spark):
    df = spark.createDataFrame([([101, 5, 6, 102],)], "ids array<bigint>")
    r = df.select(tk.truncate_pad("ids", 6).alias("p"), tk.attention_mask("ids", 6).alias("m"),
                  tk.truncate_pad("ids", 2).alias("t")).first()
    assert r.p == [101, 5, 6, 102, 0, 0] and r.m == [1, 1, 1, 1, 0, 0] and r.t == [101, 5]


def test_hash32_matches_duckdb(spark):
    import duckdb

    got = spark.createDataFrame([(7,)], "k long").select(hash32(["k"], 42).alias("h")).first().h
    want = duckdb.connect().execute(f"SELECT {sql_hash32(['k'], 42)} FROM (SELECT 7 AS k)").fetchall()[0][0]
    assert got == want


def test_mask_tokens_rates(spark):
    ids = [101] + list(range(1000, 3000)) + [102]
    df = spark.createDataFrame([("row", ids)], "k string, input_ids array<bigint>")
    r = pr.mask_tokens(df, "k", "input_ids", p=0.15, seed=1).first()
    labels = np.array(r.mlm_labels)
    chosen = labels != -100
    assert not chosen[0] and not chosen[-1]  # special tokens are never chosen
    assert 0.12 < chosen.mean() < 0.18
    new = np.array(r.mlm_input_ids)
    masked = (new == tk.MASK_ID) & chosen
    assert 0.7 < masked.sum() / chosen.sum() < 0.9
    assert (new[~chosen] == np.array(ids)[~chosen]).all()


def test_training_rows_shapes(spark):
    df = spark.createDataFrame([("a", None, "n")], "x string, y string, z string")
    assert tuple(pr.make_training_rows(df, ["x"]).first()) == ("a", "a")
    assert tuple(pr.make_training_rows(df, ["x", "y"]).first()) == ("a", " ")
    assert tuple(pr.make_training_rows(df, ["x", "y", "z"]).first()) == ("a", " ", "n")


def test_contrastive_hard_negatives_raise_loss(spark):
    rows = [(i, [1.0, float(i)], [1.0, float(i) + 0.1], [1.0, float(i) - 0.1]) for i in range(6)]
    df = spark.createDataFrame(rows, "o int, a array<double>, b array<double>, h array<double>")
    plain = mt.in_batch_contrastive(df, ["o"], "a", "b", batch_size=3, temp=0.5)
    hard = mt.in_batch_contrastive(df, ["o"], "a", "b", batch_size=3, temp=0.5, hard_negative="h")
    assert plain.count() == 2
    assert mt.mean_of_batches(hard).first().loss > mt.mean_of_batches(plain).first().loss


def test_exact_quantiles_double_column(spark):
    import math

    from recsift.operators.interactions import exact_quantiles

    vals = [x / 7 for x in range(-300, 700)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = dict(exact_quantiles(df, "x", (0.25, 0.5, 0.99)))
    s = sorted(v for v in vals if v is not None)
    assert got == {p: s[math.ceil(p * len(s)) - 1] for p in (0.25, 0.5, 0.99)}


def test_first_containing_patterns(spark):
    from recsift.operators.textmatch import first_containing

    docs = spark.createDataFrame([(5, "the quick brown fox"), (2, "a brown fox jumps"), (9, None)],
                                 "doc_id long, text string")
    pats = spark.createDataFrame([(1, "brown fox"), (2, "brown fox"), (3, "quick"), (4, "zebra"), (6, "")],
                                 "pid long, text string")
    got = {r.pid: r.target for r in first_containing(pats, docs, "pid", "text", "doc_id", "text").collect()}
    assert got == {1: 2, 2: 2, 3: 5, 6: 2}
