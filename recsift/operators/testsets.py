"""Search test-set builders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .numbering import global_row_number
from .sampling import category_positions, same_category_negatives, sample_n, satisfied_reviews


@dataclass
class SearchTestSet:
    queries: DataFrame  # qid, query, item_id
    pool: DataFrame     # item_id, category, metadata


def filter_judgements(judgements: DataFrame, cat_map: DataFrame, item: str = "product_id") -> DataFrame:
    """Exact US judgements of the small version whose item has a known
    category without 'Unknown' (inner join to the category map)."""
    j = judgements.filter((F.col("product_locale") == "us") & (F.col("relevance_label") == "Exact")
                          & (F.col("small_version") == 1))
    cats = cat_map.filter(~F.col("category").contains("Unknown"))
    return j.join(cats.withColumnRenamed("item_id", item), item)


def clean_query_text(col: str) -> F.Column:
    """Strip, tab → space."""
    return F.replace(py_strip(F.col(col)), F.lit("\t"), F.lit(" "))


def _pool(pos: DataFrame, negs: DataFrame, item_text: DataFrame) -> DataFrame:
    """U4 + J7: positives ∪ negatives as distinct (item, category), joined to
    the item text (items without text are left out). An item text that names its category
    belongs to the pool rows of that category only."""
    both = pos.unionByName(negs).distinct()
    return both.join(item_text, ["item_id", "category"] if "category" in item_text.columns else "item_id")


def build_search_testset(judgements: DataFrame, cat_map: DataFrame, item_text: DataFrame, n_neg: int = 50,
                         seed: int = 42, order: tuple[str, ...] = ("query", "product_id")) -> SearchTestSet:
    """Surviving judgements get 0-based qids (W8, distributed numbering
    in ``order``); each adds its item and ``n_neg`` seeded same-category
    negatives to the pool (J8; the whole category when smaller)."""
    kept = filter_judgements(judgements, cat_map)
    numbered = global_row_number(kept, [F.col(c) for c in order], "qid", start=0)
    queries = numbered.select("qid", clean_query_text("query").alias("query"),
                              F.col("product_id").alias("item_id"), "category")
    positions = category_positions(cat_map, "item_id", "category", seed)
    negs = same_category_negatives(queries, "qid", "category", positions, "item_id", n_neg, seed)
    pool = _pool(queries.select("item_id", "category"),
                 negs.select(F.col("neg_item").alias("item_id"), "category"), item_text)
    return SearchTestSet(queries.select("qid", "query", "item_id"), pool)


def build_complex_query_pool(reviews: DataFrame, item_cat: DataFrame, item_text: DataFrame, n_queries: int,
                             n_neg: int = 50, seed: int = 42) -> SearchTestSet:
    """Sample ``n_queries`` satisfied reviews (P2, P7), number them, and
    build the same-category candidate pool (J8, U4). The review text stands
    in for the rewritten query (the rewriting service is external)."""
    sat = satisfied_reviews(reviews)
    picked = sample_n(sat, ["user_id", "parent_asin"], n_queries, seed)
    numbered = global_row_number(picked, [F.col("user_id"), F.col("parent_asin")], "qid", start=0)
    q = numbered.join(item_cat.select(F.col("item_id").alias("parent_asin"), "category"), "parent_asin")
    queries = q.select("qid", F.col("text").alias("query"), F.col("parent_asin").alias("item_id"), "user_id",
                       F.col("rating").alias("ori_rating"), "category")
    positions = category_positions(item_cat, "item_id", "category", seed)
    negs = same_category_negatives(queries, "qid", "category", positions, "item_id", n_neg, seed)
    pool = _pool(queries.select("item_id", "category"),
                 negs.select(F.col("neg_item").alias("item_id"), "category"), item_text)
    return SearchTestSet(queries.drop("category"), pool)
