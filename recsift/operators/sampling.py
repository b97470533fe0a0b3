"""Reproducible sampling (P2, P6, P7, P12) and same-category negatives.

The reference samples with an unseeded RNG; every draw here is a seeded md5
of the row key, so reruns and the DuckDB oracle agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32, hash_bucket, hash_hex
from .numbering import global_row_number, rank_within


def satisfied_reviews(reviews: DataFrame, min_rating: float = 5.0, min_chars: int = 100,
                      rating: str = "rating", text: str = "text") -> DataFrame:
    """Top-rated reviews with at least ``min_chars`` characters (code points)."""
    return reviews.filter((F.col(rating) >= min_rating) & (F.length(text) >= min_chars))


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Keep about 1 in ``n`` rows (bucket 0 of a seeded hash)."""
    return df.filter(hash_bucket(key, seed, n) == 0)


def sample_n(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of exactly min(n, rows) rows: the n smallest
    seeded hashes (ties by key).

    A plain ``orderBy().limit(n)`` merges n rows from every partition in one
    task. Instead one counting pass measures how many rows have a 32-bit
    hash prefix below each power of two; the smallest such threshold holding
    at least n rows (so at most ~2n candidates) becomes a distributed filter
    and only those candidates are ordered. Exact: any row above the
    threshold has a larger hash than every candidate."""
    if n <= 0:
        return df.limit(0)
    h = hash32(key, seed)
    ladder = [1 << j for j in range(33)]
    row = df.agg(*[F.count(F.when(h < F.lit(t), 1)).alias(f"c{j}") for j, t in enumerate(ladder)]).first()
    if row["c32"] <= n:
        return df
    t = next(t for j, t in enumerate(ladder) if row[f"c{j}"] >= n)
    return df.filter(h < F.lit(t)).orderBy(hash_hex(key, seed), *[F.col(k) for k in key]).limit(n)


def head_percent_split(df: DataFrame, order: Sequence[str | Column], pct: float = 1.0,
                       name: str = "split") -> DataFrame:
    """The first ``pct`` % of rows in ``order`` are 'validation', the rest
    'train' (boundary = round(pct·N/100), halves up). Numbering is distributed."""
    numbered = global_row_number(df, order, "_pos")
    n = numbered.agg(F.max("_pos")).first()[0] or 0
    cut = math.floor(Fraction(repr(pct)) * n / 100 + Fraction(1, 2))
    return numbered.withColumn(name, F.when(F.col("_pos") <= cut, "validation").otherwise("train")).drop("_pos")


def category_positions(items: DataFrame, item: str, category: str, seed: int = 42) -> DataFrame:
    """Each item's place (0-based) in a seeded random permutation of its
    category, plus the category size. Skew-safe for a huge category."""
    ranked = rank_within(items.select(item, category).withColumn("_h", hash_hex([item], seed)),
                         [category], [F.col("_h"), F.col(item)], "_rn", "cat_size")
    return ranked.select(item, category, (F.col("_rn") - 1).alias("cat_pos"), "cat_size")


def same_category_negatives(queries: DataFrame, qid: str, category: str, positions: DataFrame, item: str,
                            n: int, seed: int = 42, out: str = "neg_item") -> DataFrame:
    """For each query, min(n, size) distinct items of its category: a
    seeded start in the category's permutation and the next n places
    (wrapping). Cost is queries × n rows, never queries × category."""
    sizes = positions.groupBy(category).agg(F.max("cat_size").alias("cat_size"))
    q = queries.select(qid, category).join(sizes, category)
    start = F.pmod(hash32([qid], seed), F.col("cat_size"))
    steps = F.sequence(F.lit(0), F.least(F.lit(n), F.col("cat_size")) - 1)
    q = q.select(qid, category, start.alias("_start"), "cat_size", F.explode(steps).alias("_j"))
    q = q.withColumn("cat_pos", F.pmod(F.col("_start") + F.col("_j"), F.col("cat_size")))
    return q.join(positions.select(item, category, "cat_pos"), [category, "cat_pos"]).select(
        qid, category, F.col(item).alias(out))
