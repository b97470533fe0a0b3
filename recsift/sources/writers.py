"""Sinks (K1-K9). Formats follow the reference's files; partitioned writes
replace its one-file-per-split/category loops."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.interactions import history_text
from .files import open_fs
from .readers import CSV_QUOTES

RATING_COLS = ["user_id", "parent_asin", "rating", "timestamp"]


def write_ratings(df: DataFrame, out: str, k: int, category: str | None = "category", mode: str = "overwrite") -> str:
    """K1: ``{out}/{k}core/rating_only`` CSV without header, one folder per category."""
    path = os.path.join(out, f"{k}core", "rating_only")
    w = df.select(*RATING_COLS, *([category] if category else [])).write.mode(mode).option("header", False).options(**CSV_QUOTES)
    (w.partitionBy(category) if category else w).csv(path)
    return path


def write_splits(df: DataFrame, out: str, with_history: bool = False, mode: str = "overwrite",
                 category: str | None = None) -> str:
    """K2: one folder per split (and category, if given); the history variant adds the space-joined items."""
    cols = [F.col(c) for c in RATING_COLS]
    if with_history:
        cols.append(history_text("history").alias("history"))
    by = [category] if category else []
    df.select(*cols, "split", *by).write.mode(mode).option("emptyValue", "").options(**CSV_QUOTES).partitionBy("split", *by).csv(out)
    return out


def write_inter(df: DataFrame, out: str, mode: str = "overwrite") -> str:
    """K3: TSV with the typed header ``user_id:token item_id_list:token_seq item_id:token``."""
    sel = df.select(F.col("user_id").cast("string").alias("user_id:token"),
                    history_text("history").alias("item_id_list:token_seq"),
                    F.col("parent_asin").cast("string").alias("item_id:token"))
    sel.write.mode(mode).option("sep", "\t").option("header", True).options(**CSV_QUOTES).csv(out)
    return out


PAD = "[PAD]"   # fixed value: the token of id 0


def write_id_maps(user_map: DataFrame, item_map: DataFrame, out: str, mode: str = "overwrite",
                  id_meta: DataFrame | None = None) -> str:
    """K4: id maps as JSON lines of (kind, token, id). With ``id_meta`` (id, metadata) the set is whole:
    the items' metadata by id, and ``[PAD]`` as id 0 of each kind."""
    spark = user_map.sparkSession
    kinds = [("user", user_map, 0, 1), ("item", item_map, 0, 1)] + ([("meta", id_meta, 1, 0)] if id_meta is not None else [])
    rows = spark.createDataFrame([(k, PAD, 0) for k, *_ in kinds] if id_meta is not None else [], "kind string, token string, id long")
    for kind, m, token, number in kinds:
        rows = rows.unionByName(m.select(F.lit(kind).alias("kind"), F.col(m.columns[token]).cast("string").alias("token"),
                                         F.col(m.columns[number]).cast("long").alias("id")))
    rows.write.mode(mode).json(out)
    return out


def write_categories(df: DataFrame, out: str, categories: Sequence[str], category: str = "category", suffix: str = "jsonl") -> str:
    """One JSON-lines file (folder of parts) per category, named by F16."""
    for c in categories:
        df.filter(F.col(category) == c).drop(category).write.mode("overwrite").json(f"{out.rstrip('/')}/{c.replace(' ', '_')}.{suffix}")
    return out


def write_vectors_f32(df: DataFrame, out: str, id_col: str = "id", vec_col: str = "vec", parts: int | None = None) -> str:
    """K5: float32 rows in id order as numbered raw part files; concatenating the parts in
    name order gives the matrix. ``out`` is a folder all executors reach (a path or URI).
    Every task attempt writes a file of its own below a staging folder; the attempts that
    Spark reports are moved beside the old parts as a new set first, then the old parts are removed
    and the new ones renamed to ``part-NNNNN.f32``. A crash leaves a whole old or a whole new set (``_new-NNNNN.f32``
    and a ``_NEW`` marker), never neither; the next write starts over."""
    n = parts or df.sparkSession.sparkContext.defaultParallelism
    staging = f"{out.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    for folder in (out, staging):
        fs, p = open_fs(folder)
        fs.create_dir(p, recursive=True)
    ordered = df.select(id_col, vec_col).repartitionByRange(n, id_col).sortWithinPartitions(id_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, rows = TaskContext.get().partitionId(), 0
        name = f"{staging}/{pid:05d}-{uuid.uuid4().hex}.f32"
        own, path = open_fs(name)
        with own.open_output_stream(path) as fh:
            for batch in batches:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                fh.write(flat.astype("<f4").tobytes())
                rows += batch.num_rows
        yield pa.RecordBatch.from_pydict({"part": pa.array([pid], pa.int32()), "name": [name],
                                          "rows": pa.array([rows], pa.int64())})

    done = ordered.mapInArrow(write, "part int, name string, rows long").collect()  # one row a partition
    fs, p = open_fs(out)
    p = p.rstrip("/")
    listed = lambda start: [f for f in fs.get_file_info(pafs.FileSelector(p)) if f.base_name.startswith(start) and f.base_name.endswith(".f32")]
    for stale in listed("_new-"):
        fs.delete_file(stale.path)
    for r in done:
        fs.move(open_fs(r["name"])[1], f"{p}/_new-{r['part']:05d}.f32")
    with fs.open_output_stream(f"{p}/_NEW") as marker:     # the new set is whole
        marker.write(b"")
    for old in listed("part-"):
        fs.delete_file(old.path)
    for f in listed("_new-"):
        fs.move(f.path, f"{p}/part-{f.base_name[5:]}")
    fs.delete_file(f"{p}/_NEW")
    fs.delete_dir(open_fs(staging)[1])
    return out


def write_pairs_tsv(df: DataFrame, out: str, mode: str = "overwrite") -> str:
    """K6: pre-training pairs, header ``review meta``."""
    df.select("review", "meta").write.mode(mode).option("sep", "\t").option("header", True).options(**CSV_QUOTES).csv(out)
    return out


def write_queries_csv(df: DataFrame, out: str, mode: str = "overwrite") -> str:
    """K7: ``qid, query, item_id`` with a header."""
    df.select("qid", "query", "item_id").write.mode(mode).option("header", True).options(**CSV_QUOTES).csv(out)
    return out


def write_item_pool_jsonl(df: DataFrame, out: str, mode: str = "overwrite") -> str:
    """K8: item pool as JSON lines (key ``item_id``, Q2)."""
    df.select("item_id", "category", "metadata").write.mode(mode).json(out)
    return out


def write_metrics(df: DataFrame, out: str, key: str = "metric", value: str = "value", mode: str = "overwrite") -> str:
    """K9: sorted ``key = value`` report. A metrics table is a handful of rows,
    so one sorted file is written."""
    lines = df.select(F.concat_ws(" = ", F.col(key), F.col(value).cast("string")).alias("value"), F.col(key))
    lines.orderBy(key).select("value").coalesce(1).write.mode(mode).text(out)
    return out
