"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import os
import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.memory import give_back
from ..session import ensure_checkpoint_dir, release, ship_code


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder known, package importable in Python workers."""
    ensure_checkpoint_dir(spark)
    ship_code(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workdir(spark: SparkSession, tag: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_STEPS: list[str] = []      # folders of the steps of the pipeline stage that ran last
_IN_STAGE = False


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(stored: DataFrame) -> None:
    """Delete a table written by ``materialise`` that nothing reads any more: all that came of
    it must be stored by now, since it could not be computed again."""
    files = stored.inputFiles()
    if files:
        _delete(stored.sparkSession, os.path.dirname(files[0]))


def staged(stage):
    """A pipeline stage. Its caller stores its result before the next stage begins, so the steps
    the last stage stored on its way are deleted then (unless the new input still reads them)."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _IN_STAGE
        if _STEPS:
            read = docs.inputFiles()
            if not any(os.path.basename(p) in f for p in _STEPS for f in read):
                for p in _STEPS:
                    _delete(spark, p)
                _STEPS.clear()
        release(spark)
        _IN_STAGE = True
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _IN_STAGE = False
    return run


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts
    lineage, pins generated ids, and later reads still prune columns."""
    path = workdir(df.sparkSession, tag)
    if _IN_STAGE:
        _STEPS.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function on Arrow batches. Its worker outlives the task and idles beside the steps that
    follow, so what the task used goes back at its end."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same when the text has no other
    upper-case or title-case character, and is much faster than ``translate``."""
    other = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Sk}]]"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)) \
        .when(col.rlike(other), F.translate(col, string.ascii_uppercase, string.ascii_lowercase)) \
        .otherwise(F.lower(col))


def alnum_words(col: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lowered text; null and
    empty texts have none."""
    spaced = F.trim(F.regexp_replace(ascii_lower(F.coalesce(col, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))
