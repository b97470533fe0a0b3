"""reviews that need few columns carry only these, and the shuffles of the dedup are freed before the texts move."""

import re

from recsift.operators.textprep import clean_review_text
from recsift.sources import views

SF = "/root/testdata/sf0.001"


def test_kept_interactions_are_stored_and_shuffles_freed(spark, monkeypatch):
    import __spark_entry__

    freed = []
    monkeypatch.setattr(views, "release", lambda s: freed.append(s), raising=False)
    got = __spark_entry__.queries()["clean_review_pretrain"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert freed and not re.search("lineitem|orders|rating|timestamp", plan)
    stored = [x for x in plan.splitlines() if "FileScan" in x and "documents" not in x]
    assert len(stored) == 1 and "struct<user_id:bigint,parent_asin:bigint,seq:bigint>" in stored[0]
    assert "AS doc_id" not in plan                  # the join key is computed, not shuffled
    want = clean_review_text(views.reviews(spark, SF)).select("user_id", "parent_asin", "cleaned_review")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_reviews_with_columns_are_the_same_rows(spark):
    whole = views.reviews(spark, SF)
    some = views.reviews(spark, SF, ["parent_asin", "rating", "user_id"])
    assert some.columns == ["parent_asin", "rating", "user_id", "title", "text"]
    order = lambda rows: sorted(map(str, rows))
    assert order(map(tuple, some.collect())) == order(map(tuple, whole.select(*some.columns).collect()))
