"""Item texts are cleaned and encoded once, by as many tasks as the session shuffles to."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _plan(df, optimized=False):
    q = df._jdf.queryExecution()
    return (q.optimizedPlan() if optimized else q.executedPlan()).toString()


def test_items_are_cleaned_and_encoded_once_after_they_are_spread(spark):
    plan = _plan(entry.queries()["embed_text_hash"](spark, SF))
    assert plan.count("ArrowEvalPython [enc(") == 1
    assert plan.index("Exchange RoundRobin") > plan.index("ArrowEvalPython [_unescape(")     # below it
