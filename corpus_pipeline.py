"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark
decontamination, best-fit packing. Every stage but the last returns the columns of
``documents``; ``run`` stores each stage's result as Parquet in the shared folder and
reads it back as the next stage's input. What a stage stored on its way is deleted when
the next one begins.

Defined cases, for all stages: null ids and null texts, repeated rows, empty tables and
extra columns pass through as the operators' docstrings say; a row is judged by its id and text, so rows
that share an id are kept or dropped each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recsift.llm import decontam, jaccard, linededup, packing, toxicity
from recsift.llm.common import materialise, prepare, staged, table
from recsift.llm.queries import tokenizer_path


@staged
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go (no fold is held out here)."""
    prepare(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out=None)
    scored = toxicity.score(docs, model, docs.columns, names=("__score", "__predicted"))
    return scored.filter(F.col("__predicted") == 0).select(*docs.columns)


@staged
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in their first document only."""
    prepare(spark)
    out = linededup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@staged
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of linked documents stays: sets of five-word
    shingles with a Jaccard similarity of 0.8 or more."""
    prepare(spark)
    return jaccard.JaccardJoin(k=5, num=80, den=100).keep_one(docs)


@staged
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    prepare(spark)
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


@staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with sequence and offset."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_path(), added=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# trained models and tokenizers are outside SQL; tests/llm checks the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
