"""Sources (S1-S10): every reader declares its schema (no inference) and
returns DataFrames; malformed input goes to a rejects DataFrame instead of
stopping the job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PY_SPACE_CHARS
from .files import open_fs

CORRUPT = "_corrupt_record"
# a quote inside a quoted field is doubled
CSV_QUOTES = {"quote": '"', "escape": '"'}

RATING_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("parent_asin", T.StringType()),
    T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])


def read_reviews_jsonl(spark: SparkSession, path: str, timestamp_col: str = "sortTimestamp",
                       ) -> tuple[DataFrame, DataFrame]:
    """S1 (+P1): JSON lines → (interactions, rejects).

    Fields are read as text and cast as the reference's ``float`` and ``int`` do: a quoted
    number ("12") is accepted, a quoted fraction ("1.5") is no time, and a JSON number with
    a fraction is cut towards zero. Blank lines are skipped; unparsable lines, missing keys
    and failed casts go to ``rejects`` (raw line kept)."""
    def parse(rating: T.DataType, time: T.DataType):
        schema = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("parent_asin", T.StringType()),
                               T.StructField("rating", rating), T.StructField(timestamp_col, time), T.StructField(CORRUPT, T.StringType())])
        return F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})

    def whole_record(r):
        return (r[CORRUPT].isNull() & r["user_id"].isNotNull() & r["parent_asin"].isNotNull()
                & r["rating"].isNotNull() & r["timestamp"].isNotNull())

    def record(r, rating, time):
        return F.struct(r["user_id"].alias("user_id"), r["parent_asin"].alias("parent_asin"), rating.alias("rating"),
                        time.alias("timestamp"), r[CORRUPT].alias(CORRUPT))

    def from_text(r):
        text = r[timestamp_col]
        quoted = F.col("value").rlike(r'"' + timestamp_col + r'"\s*:\s*"')
        number = text.try_cast("double")
        cut = (F.signum(number) * F.floor(F.abs(number))).try_cast("bigint")
        ts = F.coalesce(F.trim(text).try_cast("bigint"), F.when(~quoted, cut))
        whole = ~quoted | F.trim(text).rlike(r"^[+-]?[0-9]+$")
        return record(r, r["rating"].try_cast("double"), F.when(whole, ts))

    def as_text():
        return F.transform(F.array(parse(T.StringType(), T.StringType())), from_text)[0]

    # numbers are read as such; only a line that has them in another form, or none, is parsed a second time, as text.
    # The lambdas name a line's record and the generator's rows are computed once, whoever reads or filters them later.
    numbers = F.transform(F.array(parse(T.DoubleType(), T.LongType())), lambda r: record(r, r["rating"], r[timestamp_col]))
    records = F.transform(numbers, lambda r: F.when(whole_record(r), r).otherwise(as_text()))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    typed = lines.select(F.col("value").alias("line"), F.explode(records).alias("r"))
    good = typed.filter(whole_record(F.col("r"))).select("r.user_id", "r.parent_asin", "r.rating", "r.timestamp")
    return good, typed.filter(~whole_record(F.col("r"))).select("line")


def read_ratings_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """The 4-column rating CSV (no header as written by K1)."""
    return spark.read.schema(RATING_SCHEMA).option("header", header).options(**CSV_QUOTES).csv(path)


def read_split_csv(spark: SparkSession, path: str, with_history: bool = False) -> DataFrame:
    """S2 for K2 output: split files with an optional 5th history column;
    an empty history reads back as an empty array."""
    fields = list(RATING_SCHEMA.fields) + ([T.StructField("history", T.StringType())] if with_history else [])
    df = spark.read.schema(T.StructType(fields)).options(**CSV_QUOTES).csv(path)
    if with_history:
        df = df.withColumn("history", F.when(F.coalesce(F.col("history"), F.lit("")) == "",
                                             F.array().cast("array<string>"))
                           .otherwise(F.split("history", " ")))
    return df


def read_by_category(df: DataFrame, suffix: str = "json", out: str = "category") -> DataFrame:
    """S3: add the category = file stem (one file per category; a folder ``stem.suffix`` of
    part files, as Spark writes them, counts as one file)."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)\.{suffix}(?:/[^/]*)?$", 1)
    return df.withColumn(out, F.call_function("url_decode", F.replace(stem, F.lit("+"), F.lit("%2B"))))


def read_categories(spark: SparkSession, folder: str, categories: Sequence[str], schema: str, suffix: str = "jsonl",
                    out: str = "category", ordinal: str = "category_no") -> DataFrame:
    """S3: the files of ``categories`` below ``folder`` (names by F16) in one scan, with the category
    and its place in the list, by which later files win (J2, U1)."""
    stems = [c.replace(" ", "_") for c in categories]
    if len(set(stems)) < len(stems):
        raise ValueError("categories share a file name")
    raw = spark.read.schema(schema).json([f"{folder.rstrip('/')}/{s}.{suffix}" for s in stems])
    x = read_by_category(raw, suffix, "__stem")
    # one entry a category
    place = F.create_map(*[v for i, s in enumerate(stems) for v in (F.lit(s), F.lit(i))])
    names = F.array(*[F.lit(c) for c in categories])
    return x.withColumn(ordinal, F.element_at(place, F.col("__stem"))).withColumn(out, F.get(names, F.col(ordinal))).drop("__stem")


def read_json_map(spark: SparkSession, path: str, key: str = "item_id", value: str = "category") -> DataFrame:
    """One JSON object {key: value} → rows. A single JSON object cannot
    be split, so one task parses each file; convert it to Parquet once."""
    txt = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return txt.select(F.explode(m).alias(key, value))


def read_item_pool(spark: SparkSession, path: str, check_unique: bool = True) -> DataFrame:
    """S5 (+A13): JSONL pool of (item_id, category, metadata); the key may be
    written as ``item`` (Q2). Duplicate ids raise."""
    schema = "item_id string, item string, category string, metadata string"
    df = spark.read.schema(schema).json(path)
    df = df.select(F.coalesce("item_id", "item").alias("item_id"), "category", "metadata")
    if check_unique:
        assert_unique(df, ["item_id"])
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Ids unique (partial-aggregate count, one row to the driver)."""
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {dup[0].asDict()}")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query CSV with a header. A quoted query may hold line breaks, so a file is one
    task; give a folder of files."""
    schema = "qid long, query string, item_id string, user_id string, ori_rating float, ori_review string"
    return spark.read.schema(schema).option("header", True).option("multiLine", True).options(**CSV_QUOTES).csv(path)


def read_text_pairs(spark: SparkSession, path: str, columns: tuple[str, ...] = ("sent0", "sent1")) -> DataFrame:
    """Csv / tsv / json / txt by extension. For delimited files a row with
    fewer fields is kept with nulls, a row with more fields is skipped."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext == "txt":
        return spark.read.text(path).withColumnRenamed("value", columns[0])
    if ext in ("json", "jsonl"):
        return spark.read.schema(", ".join(f"{c} string" for c in columns)).json(path)
    sep = "\t" if ext == "tsv" else ","
    schema = ", ".join(f"{c} string" for c in columns) + f", {CORRUPT} string"
    df = (spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).options(**CSV_QUOTES).csv(path))
    too_many = F.col(CORRUPT).isNotNull() & F.col(columns[-1]).isNotNull()
    return df.filter(~too_many).drop(CORRUPT)


VECTOR_BLOCK_BYTES = 64 << 20


def read_vectors_f32(spark: SparkSession, path: str, dim: int, first_id: int = 0) -> DataFrame:
    """A raw little-endian float32 matrix, one file or a folder of part files in name
    order (file row i = id first_id + i). The ids follow from the file sizes: every block
    of rows knows its file, its offset and its first id, and is read by its own task."""
    width = 4 * dim
    files = sorted((r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path)
                   .select("path", "length").collect())    # one row a file
    step = max(1, VECTOR_BLOCK_BYTES // width)
    blocks, at = [], first_id
    for name, size in files:
        if size % width:
            raise ValueError(f"{name}: {size} bytes are no rows of {dim} floats")
        rows = size // width
        blocks += [(name, lo, min(step, rows - lo), at + lo) for lo in range(0, rows, step)]
        at += rows
    schema = "id long, vec array<float>"
    if not blocks:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, lo, n, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                fs, p = open_fs(name)
                with fs.open_input_file(p) as f:
                    for a in range(0, n, 8192):
                        m = min(8192, n - a)
                        flat = np.frombuffer(f.read_at(m * width, (lo + a) * width), dtype="<f4")
                        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * dim, dim, dtype=np.int32)), pa.array(flat))
                        ids = pa.array(np.arange(first + a, first + a + m, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([ids, vec], names=["id", "vec"])

    table = spark.createDataFrame(blocks, "path string, lo long, n long, first long")
    return table.repartition(min(len(blocks), 10_000), "path", "lo").mapInArrow(run, schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One sentence per line, right-stripped."""
    return spark.read.text(path).select(F.rtrim("value", F.lit(PY_SPACE_CHARS)).alias("text"))


def read_category_list(spark: SparkSession, path: str) -> DataFrame:
    """One category per line, stripped."""
    return spark.read.text(path).select(F.btrim("value", F.lit(PY_SPACE_CHARS)).alias("category"))
