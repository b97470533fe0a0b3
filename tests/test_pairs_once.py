"""Pre-training pairs: texts are cleaned once."""

from recsift.operators.pairs import build_pretrain_pairs


def _plan(df, optimized=False):
    q = df._jdf.queryExecution()
    return (q.optimizedPlan() if optimized else q.executedPlan()).toString()


def test_pairs_clean_a_review_once(spark):
    reviews = spark.createDataFrame([(u, 1, 1, "t", "x" * 40 + "\n") for u in range(60)] + [(99, 1, 1, None, "short")],
                                    "user_id long, parent_asin long, timestamp long, title string, text string")
    items = spark.createDataFrame([(1, "y" * 40, ["f"], ["d"]), (2, "z", [], [])],
                                  "parent_asin long, title string, features array<string>, description array<string>")
    pairs = build_pretrain_pairs(reviews, items, 10, 1)
    assert {(r.user_id, r.review, r.meta) for r in pairs.collect()} == {(u, "t " + "x" * 40, "y" * 40 + " f d") for u in range(60)}
    # one cleaning each of the review and the item (a filter on a computed column would hold another) and the sample's key
    assert _plan(pairs, optimized=True).count("concat_ws") == 3
