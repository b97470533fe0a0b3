"""Domain views over the driver's parquet tables (FIXTURES.md §2).

The driver ships TPC-H-like tables; these functions derive the reference's
inputs from them: interactions, item metadata, reviews, search judgements,
a text corpus with queries, text pairs and vectors. Only the columns a view
needs are selected, so Parquet scans stay pruned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.interactions import ITEM, TS, USER, dedup_keep_earliest
from ..operators.userlog import UserLog, build_user_log
from ..session import release, shared, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_millis(col: str) -> F.Column:
    """Parquet timestamps load as TIMESTAMP_NTZ; read them as UTC instants."""
    return F.unix_millis(F.col(col).cast("timestamp"))


def raw_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reviews: (user, item, rating, ms timestamp, ingest seq);
    (user, item) pairs repeat."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("parent_asin"),
        (F.lit(1) + F.floor("l_quantity").cast("bigint") % 5).cast("double").alias("rating"),
        (epoch_millis("o_orderdate") + F.col("l_linenumber")).alias("timestamp"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-earliest interactions: one row per (user, item)."""
    return dedup_keep_earliest(raw_interactions(spark, sf_dir))


def source(sf_dir: str, *names: str) -> list[str]:
    """Paths of driver tables."""
    return [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names]


def user_log(spark: SparkSession, sf_dir: str) -> UserLog:
    """The deduplicated, ranked interactions, stored by user once an application."""
    return shared(spark, "user_log", source(sf_dir, "lineitem", "orders"),
                  lambda: build_user_log(raw_interactions(spark, sf_dir)))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metadata; parts with p_size > 45 have none, every 4th size has an
    empty description."""
    p = table(spark, sf_dir, "part").filter(F.col("p_size") <= 45)
    return p.select(
        F.col("p_partkey").alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.array("p_type", "p_brand").alias("features"),
        F.array("p_brand").alias("categories"),
        F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>"))
         .otherwise(F.array("p_name", "p_type")).alias("description"),
        F.col("p_brand").alias("category"),
    )


def reviews(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Interactions with review text (title null on every 10th seq). With ``columns`` only those of the interactions' columns
    are carried; the kept interactions are stored first, and what they were shuffled through is freed before the texts are."""
    if columns is None:
        ix = interactions(spark, sf_dir)
    else:
        ix = dedup_keep_earliest(raw_interactions(spark, sf_dir).select(*dict.fromkeys([USER, ITEM, TS, "seq", *columns])))
        ix = stored(ix.select(*dict.fromkeys([*columns, "seq"])))
        release(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = docs.count()
    # the number of the document is computed from seq on either side of the exchange, not carried
    out = ix.join(docs, F.pmod(F.col("seq"), F.lit(n_docs)) == F.col("doc_id"))
    return out.select(*(ix.columns if columns is None else columns),
                      F.when(F.col("seq") % 10 == 0, F.lit(None).cast("string"))
                       .otherwise(F.substring("text", 1, 20)).alias("title"),
                      "text")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", "l_returnflag", "l_linenumber")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.concat_ws(" ", "p_name", "p_type").alias("query"),
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_linestatus") == "O", "us").otherwise("es").alias("product_locale"),
        F.when(F.col("l_returnflag") == "N", "Exact").when(F.col("l_returnflag") == "R", "Substitute")
         .otherwise("Irrelevant").alias("relevance_label"),
        (F.col("l_linenumber") % 2).cast("bigint").alias("small_version"),
    )


def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item → category (the reference's asin2category); brands containing '#5'
    are renamed to 'Unknown …' so the filter that skips them is exercised."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return p.select(F.col("p_partkey").alias("item_id"),
                    F.when(F.col("p_brand").endswith("5"), F.concat(F.lit("Unknown "), "p_brand"))
                     .otherwise(F.col("p_brand")).alias("category"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("category"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries; target = first document containing the
    whole passage (exact multi-pattern match, see :mod:`..operators.textmatch`)."""
    from ..operators.textmatch import first_containing
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return first_containing(bench, docs, "qid", "query", "doc_id", "text", "target")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn followed by the assistant's answer."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("sent0"))
    b = (c.filter(F.col("role") == "assistant")
         .select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sent1")))
    return a.join(b, ["conv_id", "turn"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
