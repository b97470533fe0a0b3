"""Ranking metrics and batch losses.

One relevant item per query: NDCG@k = 1/log2(rank+1) when the target is
ranked within k, else 0; Recall@k (hit) = 1 within k, else 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import global_row_number

ALL = "__all__"


def rank_of_target(ranked: DataFrame, targets: DataFrame, qid: str, item: str, target: str,
                   rank: str = "rank") -> DataFrame:
    """Each target row gets the rank of its item in the ranked list
    (null when absent). Equi-join on (query, item)."""
    r = ranked.select(F.col(qid), F.col(item).alias(target), F.col(rank))
    return targets.join(r, [qid, target], "left")


def ndcg_at(rank: str | Column, k: int) -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(r.isNotNull() & (r <= k), F.lit(1.0) / F.log2(r + 1)).otherwise(F.lit(0.0))


def recall_at(rank: str | Column, k: int) -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(r.isNotNull() & (r <= k), F.lit(1.0)).otherwise(F.lit(0.0))


def with_metrics(df: DataFrame, ks: Sequence[int], rank: str = "rank", recall: bool = True) -> DataFrame:
    for k in ks:
        df = df.withColumn(f"ndcg_{k}", ndcg_at(rank, k))
        if recall:
            df = df.withColumn(f"recall_{k}", recall_at(rank, k))
    return df


def mean_metric(df: DataFrame, by: str, metrics: Sequence[str], digits: int = 6) -> DataFrame:
    """Overall and per-``by`` means in one result (GROUPING SETS ((by), ())
    via rollup); the overall row has ``by`` = '__all__'."""
    aggs = [F.count(F.lit(1)).alias("n_queries")] + [F.round(F.avg(m), digits).alias(m) for m in metrics]
    out = df.rollup(by).agg(F.grouping(by).alias("_g"), *aggs)
    return out.withColumn(by, F.when(F.col("_g") == 1, F.lit(ALL)).otherwise(F.col(by).cast("string"))).drop("_g")


# ------------------------------------------------------------------ D23 / A12
def _batch_loss(temp: float, hard_weight: float, mask_mode: str, key: str | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack(pdf["_a"].to_numpy()).astype(np.float64)
        b = np.stack(pdf["_b"].to_numpy()).astype(np.float64)

        def unit(m):
            n = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

        a, b = unit(a), unit(b)
        logits = a @ b.T / temp
        extra = None
        if "_h" in pdf.columns:
            h = unit(np.stack(pdf["_h"].to_numpy()).astype(np.float64))
            extra = a @ h.T / temp
            # a logit added to the own hard negative only
            extra[np.diag_indices(len(pdf))] += hard_weight
        pos = np.diag(logits).copy()
        if key is not None:
            kv = pdf[key].to_numpy()
            same = (kv[:, None] == kv[None, :]) & ~np.eye(len(pdf), dtype=bool)
            if mask_mode == "drop":
                logits = np.where(same, -np.inf, logits)
            else:  # 'zero_logit': the reference puts logit 0 there
                logits = np.where(same, 0.0, logits)
        full = logits if extra is None else np.concatenate([logits, extra], axis=1)
        m = full.max(axis=1, keepdims=True)
        lse = (m[:, 0] + np.log(np.exp(full - m).sum(axis=1)))
        loss = lse - pos
        return pd.DataFrame({"batch": [int(pdf["_batch"].iloc[0])], "n": [len(pdf)], "loss": [float(loss.mean())]})
    return run


def in_batch_contrastive(pairs: DataFrame, order: Sequence[str | Column], a: str, b: str, batch_size: int = 64,
                         temp: float = 0.05, hard_negative: str | None = None, hard_weight: float = 0.0,
                         positive_key: str | None = None, mask_mode: str = "drop",
                         encode: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mean in-batch contrastive loss (InfoNCE over cosine / temp).

    Rows are numbered in ``order`` (distributed) and cut into batches of
    ``batch_size``; each batch is one bounded group scored with one matrix
    product. Row i's positive is b_i; the other b_j of the batch (and all
    hard negatives, if given) are its negatives. With ``positive_key``, other
    rows sharing row i's key are dropped from its denominator
    (``mask_mode='drop'``) or get logit 0 (``'zero_logit'``, as the
    reference). ``hard_weight`` is a logit added to row i's own hard negative
    (0: none). ``encode`` adds the vector columns to the numbered rows: the sort, which reads its input twice
    (once to sample it), and the stored table then hold the texts. Returns per-batch (batch, n, loss)."""
    numbered = global_row_number(pairs, order, "_pos", start=0)
    if encode is not None:
        numbered = encode(numbered)
    cols = [F.floor(F.col("_pos") / batch_size).cast("long").alias("_batch"), F.col(a).alias("_a"), F.col(b).alias("_b")]
    if hard_negative:
        cols.append(F.col(hard_negative).alias("_h"))
    if positive_key:
        cols.append(F.col(positive_key))
    df = numbered.select(*cols)
    return df.groupBy("_batch").applyInPandas(_batch_loss(temp, hard_weight, mask_mode, positive_key),
                                              "batch long, n long, loss double")


def mean_of_batches(batch_losses: DataFrame, digits: int = 6) -> DataFrame:
    """Mean over batches of the batch means (one row), and the same with its sign flipped,
    as ``objective`` (higher is better)."""
    return batch_losses.agg(F.count(F.lit(1)).alias("n_batches"), F.round(F.avg("loss"), digits).alias("loss"),
                            F.round(-F.avg("loss"), digits).alias("objective"))


def corpus_stats(queries: DataFrame, items: DataFrame, qtext: str = "query", itext: str = "text",
                 digits: int = 2) -> DataFrame:
    """Number of queries and items and their mean length in characters,
    as (metric, value) rows (one aggregate per input)."""
    def stats(df, text, n_name, m_name):
        one = df.agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg(F.length(text)), digits).alias("m"))
        pairs = F.array(F.struct(F.lit(n_name).alias("metric"), F.col("n").alias("value")),
                        F.struct(F.lit(m_name).alias("metric"), F.col("m").alias("value")))
        return one.select(F.explode(pairs).alias("_p")).select("_p.metric", "_p.value")
    return stats(queries, qtext, "n_queries", "mean_query_chars").unionByName(
        stats(items, itext, "n_items", "mean_item_chars"))


def items_by_category(cat_map: DataFrame, item: str = "item_id", category: str = "category") -> DataFrame:
    """Distinct items per category, long form (category, n_items)."""
    return cat_map.select(category, item).distinct().groupBy(category).agg(F.count(F.lit(1)).alias("n_items"))


def category_items(cat_map: DataFrame, item: str = "item_id", category: str = "category") -> DataFrame:
    """The distinct items of every category with their 1-based ``position`` in the
    category; a category that holds a third of all rows is ranked by many tasks."""
    from .numbering import rank_within

    return rank_within(cat_map.select(category, item).distinct(), [category], [item], "position").select(category, item, "position")
