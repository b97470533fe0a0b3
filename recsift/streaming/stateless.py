"""Structured Streaming use of the stateless operators.

The reference has no streams. Operators that look at one row at a time —
typed review parsing (S1/P1), text cleaning (D7-D9), the filters and seeded
samples (P2, P4-P6), the absolute-time split rule (D2) — are plain Column
expressions and so apply unchanged to a streaming DataFrame. Operators that
need a user's whole history (dedup, last-out, histories, k-core) are batch
only. This module wires the stateless ones to a file stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_bucket
from ..functions.text import flat_text
from ..operators.interactions import timestamp_split_col

REVIEW_STREAM_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("parent_asin", T.StringType()),
    T.StructField("rating", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


def review_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """JSON-lines reviews arriving as files; fields typed with ``try_cast``
    (P1); rows that do not parse are dropped from this stream."""
    raw = (spark.readStream.schema(REVIEW_STREAM_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .json(path))
    typed = raw.select("user_id", "parent_asin", F.expr("try_cast(rating AS DOUBLE)").alias("rating"),
                       F.expr("try_cast(timestamp AS BIGINT)").alias("timestamp"), "title", "text")
    return typed.filter(F.col("user_id").isNotNull() & F.col("parent_asin").isNotNull()
                        & F.col("rating").isNotNull() & F.col("timestamp").isNotNull())


def clean_and_route(reviews: DataFrame, t_valid: int, t_test: int, sample_n: int | None = None,
                    seed: int = 42, min_chars: int = 30) -> DataFrame:
    """Per-row preparation: D9 review text, length filter (P4), optional
    seeded 1-in-n sample (P6) and the time-split label (D2)."""
    out = reviews.withColumn("cleaned_review", flat_text(F.concat_ws(" ", "title", "text")))
    out = out.filter(F.length("cleaned_review") > min_chars)
    if sample_n:
        out = out.filter(hash_bucket(["user_id", "parent_asin"], seed, sample_n) == 0)
    return out.withColumn("split", timestamp_split_col("timestamp", t_valid, t_test)).drop("title", "text")


def start_to_table(df: DataFrame, checkpoint: str, out_path: str, trigger_once: bool = True):
    """Append to Parquet with a checkpoint folder (exactly-once file sink)."""
    w = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start(out_path)
