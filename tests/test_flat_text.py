"""Flattened texts: the same text as Python gives, without walking it for what it does not hold."""

import re

from recsift.functions.text import PY_SPACE_CHARS, flat_text


def _plan(df, optimized=False):
    q = df._jdf.queryExecution()
    return (q.optimizedPlan() if optimized else q.executedPlan()).toString()


def test_flat_text_is_python_strip_of_the_replaced_text(spark):
    texts = ["", " ", "a", "\r", "\ra\r b", "a\tb\nc\r\nd", "\t\ra\n", "a\r \r", "x" * 50 + "\r"]
    texts += [w + "m\u00e9 n" + v for w in PY_SPACE_CHARS for v in ("", w)] + ["\u200b a \u200b", "\U0001f600 ", "\ufeffa"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", flat_text("t").alias("x")).collect()}
    assert got == {i: t.replace("\t", " ").replace("\n", " ").replace("\r", "").strip(PY_SPACE_CHARS)
                   for i, t in enumerate(texts)} | {len(texts): None}


def test_flat_text_strips_only_texts_with_white_ends(spark):
    plan = _plan(spark.createDataFrame([("a",)], "t string").select(flat_text("t").alias("x")), optimized=True)
    assert len(re.findall(r"replace\(", plan)) == 3 and "EndsWith" in plan
