"""Session helpers: building a session for local runs and reliable checkpoints.

On a cluster the operator reads ``spark.checkpoint.dir`` from the session (a
shared, fault-tolerant folder). Only when that setting is missing *and* the
master is local (tests, bench) do we create a scratch folder ourselves.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of rounds that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", app: str = "recsift") -> SparkSession:
    """A local session with the settings the library assumes (UTC, AQE)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``checkpoint()`` has a reliable target and return it.

    Order: an already configured SparkContext checkpoint dir, then the
    ``spark.checkpoint.dir`` session setting; a scratch folder only for a
    local master where nothing is configured.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; iterative operators cut lineage there")
    path = tempfile.mkdtemp(prefix="recsift-ckpt-", dir=os.environ.get("RECSIFT_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (pandas UDFs and
    ``mapInPandas`` functions refer to it), whatever the driver's working
    directory: zip it once per SparkContext and ``addPyFile`` it."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="recsift-code-"), "recsift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder (cuts lineage,
    survives executor loss, and pins non-deterministic expressions such as
    ``monotonically_increasing_id`` so two later passes agree)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def workdir(spark: SparkSession, tag: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_SHARED: dict[tuple, object] = {}


def source_state(spark: SparkSession, *paths: str) -> tuple:
    """Length, number of files and modification time of input paths."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        size = fs.getContentSummary(path)
        out.append((p, size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def shared(spark: SparkSession, what: str, paths: Sequence[str], build: Callable[[], T]) -> T:
    """What several queries read from the same unchanged inputs is built once an application."""
    key = (spark.sparkContext.applicationId, what, source_state(spark, *paths))
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back: like
    :func:`stable`, but later scans still prune columns and push filters down."""
    path = workdir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose results are stored by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
