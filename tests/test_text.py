import html
import random

import pytest
from pyspark.sql import functions as F

from recsift.functions import text as tx
from recsift.operators import textprep as tp


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("inp,out", [("a", "a."), ("a..", "a."), ("...", ".."), (".", ".."), ("", ".")])
def test_final_dot(spark, inp, out):
    assert one(spark, tx.final_dot, inp) == out


def test_rec_clean_example(spark):
    assert one(spark, tx.clean_rec_text, " <b>A&amp;B</b>\n café ") == "A&B caf "


def test_py_strip_matches_python(spark):
    rnd = random.Random(3)
    alphabet = list("ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0       　​é")
    vals = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r.y for r in df.select(tx.py_strip("x").alias("y")).collect()]
    assert got == [v.strip() for v in vals]


def test_unescape_matches_python(spark):
    vals = ["&amp;", "&amp", "&am", "&lt;b&gt;", "&#39;x&#x41;", "&amp;lt;", "no entity", None, "&copy;&middot;&quot;"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r.y for r in df.select(tx.html_unescape("x").alias("y")).collect()]
    assert got == [None if v is None else html.unescape(v) for v in vals]


def test_search_clean_null_and_empty_description(spark):
    df = spark.createDataFrame([("k1", "T", None), ("k2", "T", [])], "parent_asin string, title string, description array<string>")
    got = {r.parent_asin: r.cleaned_metadata for r in tp.clean_item_text_search(df).collect()}
    assert got == {"k1": "T. ", "k2": "T. . "}


def test_rec_clean_fields(spark):
    df = spark.createDataFrame([("k", None, ["x", "y"], [], ["d"])],
                               "parent_asin string, title string, features array<string>, categories array<string>, "
                               "description array<string>")
    assert tp.clean_item_text_rec(df).first().cleaned_metadata == " x, y.  d. "


def test_pretrain_glue(spark):
    df = spark.createDataFrame([(None, "x"), ("t", None), ("t", "a\tb\r\n")], "title string, text string")
    got = [r.cleaned_review for r in tp.clean_review_text(df).collect()]
    assert got == ["x", "t", "t a b"]


def test_length_limits(spark):
    from recsift.operators.pairs import build_pretrain_pairs

    items = spark.createDataFrame([("i30", "a" * 30, [], []), ("i31", "a" * 31, [], [])],
                                  "parent_asin string, title string, features array<string>, description array<string>")
    reviews = spark.createDataFrame([("u", "i30", 1, None, "r" * 31), ("u", "i31", 1, None, "r" * 31),
                                     ("v", "i31", 1, None, "r" * 30)],
                                    "user_id string, parent_asin string, timestamp long, title string, text string")
    got = build_pretrain_pairs(reviews, items, t_valid=10, downsample=1).collect()
    assert [(r.user_id, r.parent_asin) for r in got] == [("u", "i31")]


def test_tokenize_stop_words(spark):
    got = one(spark, lambda c: tx.tokenize(c, ["the", "a"]), "The cat, a dog; the END.")
    assert got == ["The", "cat", "dog", "END"]


def test_union_later_wins(spark):
    a = spark.createDataFrame([("x", "old"), ("y", "only-a")], "k string, v string")
    b = spark.createDataFrame([("x", "new")], "k string, v string")
    got = {r.k: r.v for r in tp.union_later_wins([a, b], "k", ["v"]).collect()}
    assert got == {"x": "new", "y": "only-a"}
