"""Registered queries over the interaction table."""

from __future__ import annotations


from ..operators import interactions as ops
from ..operators import userlog
from ..session import shared
from ..sources import views
from .catalog import register
from .sqlviews import sql

K = 20  # k-core threshold used by the registry (k=5 barely filters this data)


def _thresholds(spark, sf_dir):
    """Split times of the interactions, found once an application."""
    got = shared(spark, "thresholds", views.source(sf_dir, "lineitem", "orders"), lambda: {
        r["fraction"]: r["threshold"] for r in ops.split_thresholds(views.raw_interactions(spark, sf_dir), (0.8, 0.9)).collect()})
    return int(got[0.8]), int(got[0.9])


@register("dedup_keep_earliest", "W1", sql("SELECT * FROM interactions", "interactions"))
def q_dedup(spark, sf):
    return views.interactions(spark, sf)


@register("user_counts", "A1", sql(
    "SELECT user_id, count(*) AS n_interactions FROM interactions GROUP BY 1", "interactions"))
def q_user_counts(spark, sf):
    return ops.user_counts(views.interactions(spark, sf))


@register("item_counts", "A1", sql(
    "SELECT parent_asin, count(*) AS n_interactions FROM interactions GROUP BY 1", "interactions"))
def q_item_counts(spark, sf):
    return ops.item_counts(views.interactions(spark, sf))


_SPLIT_LAST = "CASE WHEN n_user = rn THEN 'test' WHEN n_user - rn = 1 THEN 'valid' ELSE 'train' END"
_HIST = ("coalesce(array_to_string(list(CAST(parent_asin AS VARCHAR)) OVER (PARTITION BY user_id "
         "ORDER BY \"timestamp\", parent_asin ROWS BETWEEN {lo} PRECEDING AND 1 PRECEDING), ' '), '')")


def _hist(n=None):
    return _HIST.format(lo="UNBOUNDED" if n is None else n)


@register("last_out", "W2 W3 D3", sql(
    f"SELECT user_id, parent_asin, rating, \"timestamp\", seq, {_SPLIT_LAST} AS split FROM ranked", "ranked"))
def q_last_out(spark, sf):
    return userlog.last_out(views.user_log(spark, sf))


@register("last_out_history", "W4 D3", sql(
    f"SELECT user_id, parent_asin, rating, \"timestamp\", seq, {_SPLIT_LAST} AS split, {_hist()} AS history "
    "FROM ranked", "ranked"))
def q_last_out_history(spark, sf):
    out = userlog.last_out(views.user_log(spark, sf), history=True)
    return out.withColumn("history", ops.history_text("history"))


@register("split_thresholds", "A10", sql(
    "SELECT 0.8::DOUBLE AS fraction, t_valid AS threshold FROM thresholds "
    "UNION ALL SELECT 0.9::DOUBLE, t_test FROM thresholds", "thresholds"))
def q_split_thresholds(spark, sf):
    return ops.split_thresholds(views.raw_interactions(spark, sf), (0.8, 0.9))


_SPLIT_TS = ("CASE WHEN \"timestamp\" >= t_test THEN 'test' WHEN \"timestamp\" >= t_valid THEN 'valid' "
             "ELSE 'train' END")


@register("timestamp_split", "D2", sql(
    f"SELECT user_id, parent_asin, rating, \"timestamp\", seq, {_SPLIT_TS} AS split "
    "FROM interactions, thresholds", "interactions", "thresholds"))
def q_timestamp_split(spark, sf):
    t_valid, t_test = _thresholds(spark, sf)
    return ops.timestamp_split(views.interactions(spark, sf), t_valid, t_test)


@register("timestamp_split_history", "D2 W4", sql(
    f"SELECT user_id, parent_asin, rating, \"timestamp\", seq, {_SPLIT_TS} AS split, {_hist()} AS history "
    "FROM interactions, thresholds", "interactions", "thresholds"))
def q_timestamp_split_history(spark, sf):
    t_valid, t_test = _thresholds(spark, sf)
    out = userlog.timestamp_split(views.user_log(spark, sf), t_valid, t_test, history=True)
    return out.withColumn("history", ops.history_text("history"))


@register("shared_history", "W4", sql(
    f"SELECT user_id, parent_asin, \"timestamp\", {_hist()} AS history FROM interactions", "interactions"))
def q_shared_history(spark, sf):
    """Full histories expanded at the sink from blocks of 8 items that all rows of a user share."""
    log = views.user_log(spark, sf)
    out = userlog.expand_history(*userlog.history_refs(log, block=8), log.user)
    return out.select("user_id", "parent_asin", "timestamp", ops.history_text("history").alias("history"))


def _bounded(n):
    @register(f"bounded_history_{n}", "W5", sql(
        f"SELECT user_id, parent_asin, \"timestamp\", {_hist(n)} AS history FROM interactions", "interactions"))
    def q(spark, sf):
        out = userlog.bounded_history(views.user_log(spark, sf), n)
        return out.select("user_id", "parent_asin", "timestamp", ops.history_text("history").alias("history"))
    return q


_bounded(50)
_bounded(5)


def kcore_sql(k_user: int, k_item: int, rounds: int = 12, trace: bool = False) -> str:
    """Unrolled k-core: extra rounds change nothing once the core is reached."""
    extra = [("e0*", 'SELECT user_id, parent_asin, rating, "timestamp", seq FROM interactions')]
    for r in range(1, rounds + 1):
        extra.append((f"e{r}*", f"""
            SELECT * FROM e{r-1}
            WHERE user_id IN (SELECT user_id FROM e{r-1} GROUP BY 1 HAVING count(*) >= {k_user})
              AND parent_asin IN (SELECT parent_asin FROM e{r-1} GROUP BY 1 HAVING count(*) >= {k_item})"""))
    if not trace:
        body = f"SELECT * FROM e{rounds}"
    else:
        body = "\nUNION ALL\n".join(
            f"SELECT CAST({r} AS INTEGER) AS round, count(*) AS interactions, count(DISTINCT user_id) AS users, "
            f"count(DISTINCT parent_asin) AS items FROM e{r} HAVING count(*) < (SELECT count(*) FROM e{r-1})"
            for r in range(1, rounds + 1))
    return sql(body, "interactions", extra=tuple(extra))


@register(f"k_core_{K}", "A2 J4", kcore_sql(K, K))
def q_k_core(spark, sf):
    return ops.k_core(views.interactions(spark, sf), K).edges


@register(f"k_core_{K}_trace", "A3", kcore_sql(K, K, trace=True))
def q_k_core_trace(spark, sf):
    return ops.k_core(views.interactions(spark, sf), K).trace_df(spark)


@register("k_core_user0_item30", "A2", kcore_sql(0, 30))
def q_k_core_items_only(spark, sf):
    return ops.k_core(views.interactions(spark, sf), 0, 30).edges
