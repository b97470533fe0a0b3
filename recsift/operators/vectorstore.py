"""A stored cell index over vectors.

``<path>/vectors`` is Parquet partitioned by cell, with the unit vectors and whatever columns the caller keeps (such as the
sentence); ``<path>/meta`` holds centroids, the number of cells to probe and the recall it
was measured with. Cells grow with the rows (about the square root of their number) and come from
k-means over at most ``FIT_ROWS`` vectors (by id hash); every vector is indexed. The probe number is measured once, when
the index is built or asked to, and kept with it. A search reads only the cells that its queries probe (partition
pruning); new rows are appended to the cells they belong to.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stable
from .dense import _nearest_cells, ivf_search, l2_normalize, probes_for_recall

FIT_ROWS = 100_000     # vectors that k-means sees
MAX_CELLS = 4096
FILE_ROWS = 1_000_000  # vectors of a cell that one task writes


@dataclass
class VectorStore:
    spark: SparkSession
    path: str
    item: str
    centroids: np.ndarray
    n_probe: int
    recall: float        # of n_probe, as measured

    @property
    def rows(self) -> DataFrame:
        """``item, _u`` (unit vector), kept columns, ``cell``."""
        return self.spark.read.parquet(f"{self.path}/vectors")


def _fit_cells(unit: DataFrame, n: int, cells: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, FIT_ROWS / max(n, 1))
    some = unit if share == 1.0 else unit.filter(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    model = KMeans(k=cells, seed=seed, maxIter=10, initMode="k-means||").fit(some.select(array_to_vector("_u").alias("features")))
    cents = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    nrm = np.linalg.norm(cents, axis=1, keepdims=True)
    return np.divide(cents, nrm, out=np.zeros_like(cents), where=nrm > 0)


def _write(rows: DataFrame, item: str, vec: str, keep: list[str], cents: np.ndarray, path: str, n: int) -> None:
    spark = rows.sparkSession
    unit = rows.filter(F.col(vec).isNotNull()).select(item, *keep, l2_normalize(vec).alias("_u"))
    cols = [item, *keep, "_u"]
    schema = ", ".join(f"`{c}` {unit.schema[c].dataType.simpleString()}" for c in cols)
    dealt = unit.mapInPandas(_nearest_cells(spark.sparkContext.broadcast(cents), "_u", 1, cols), f"{schema}, cell int")
    spread = max(1, math.ceil(n / (len(cents) * FILE_ROWS)))
    # a crowded cell is written by several tasks
    dealt.repartition("cell", F.pmod(F.xxhash64(item), F.lit(spread))).write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def build_store(items: DataFrame, path: str, item: str = "item_id", vec: str = "vec", keep: list[str] | None = None,
                n_cells: int | None = None, queries: DataFrame | None = None, qid: str = "qid", k: int = 10,
                target: float = 0.9, seed: int = 42) -> VectorStore:
    """Index all rows with a vector. ``queries`` (qid, vec) are what recall is measured
    with (at most ``dense.RECALL_QUERIES``); without them the indexed vectors themselves are."""
    spark = items.sparkSession
    n = items.filter(F.col(vec).isNotNull()).count()
    cells = max(1, min(n_cells or math.ceil(math.sqrt(n) / 4), MAX_CELLS, max(n, 1)))
    unit = items.filter(F.col(vec).isNotNull()).select(F.col(item).alias("_id"), l2_normalize(vec).alias("_u"))
    cents = _fit_cells(unit, n, cells, seed) if n else np.zeros((1, 1))
    _write(items, item, vec, keep or [], cents, path, n)
    store = VectorStore(spark, path, item, cents, len(cents), 1.0)
    asked = queries if queries is not None else items.select(F.col(item).alias(qid), vec)
    return measure(store, asked, qid, vec, k, target)


def measure(store: VectorStore, queries: DataFrame, qid: str = "qid", vec: str = "vec", k: int = 10, target: float = 0.9) -> VectorStore:
    """Measure the number of cells to probe and keep it with the index."""
    found = probes_for_recall(store.rows.select(store.item, "_u", "cell"), store.centroids, queries, k, target, qid=qid, qvec=vec, item=store.item)
    store.n_probe, store.recall = found, target
    meta = [(store.item, store.centroids.tolist(), store.n_probe, store.recall)]
    store.spark.createDataFrame(meta, "item string, centroids array<array<double>>, n_probe int, recall double") \
        .coalesce(1).write.mode("overwrite").parquet(f"{store.path}/meta")
    return store


def open_store(spark: SparkSession, path: str) -> VectorStore:
    m = spark.read.parquet(f"{path}/meta").first()
    return VectorStore(spark, path, m["item"], np.array(m["centroids"]), m["n_probe"], m["recall"])


def append(store: VectorStore, new_rows: DataFrame, vec: str = "vec") -> None:
    """New rows join the cells of their nearest centroids (ids must stay unique)."""
    keep = [c for c in store.rows.columns if c not in (store.item, "_u", "cell")]
    _write(new_rows, store.item, vec, keep, store.centroids, store.path, new_rows.count())


def probed_rows(store: VectorStore, cells: list[int]) -> DataFrame:
    return store.rows.filter(F.col("cell").isin(cells)) if cells else store.rows.limit(0)


def search(store: VectorStore, queries: DataFrame, k: int = 10, threshold: float | None = None, n_probe: int | None = None,
           qid: str = "qid", qvec: str = "vec") -> DataFrame:
    """``qid, item, score, rank`` and the kept columns of the first ``k`` rows of the probed
    cells; with ``threshold`` only rows whose cosine reaches it."""
    probe = n_probe or store.n_probe
    bc = store.spark.sparkContext.broadcast(store.centroids)
    typ = dict(queries.dtypes)[qid]
    q = stable(queries.filter(F.col(qvec).isNotNull()).select(qid, qvec))
    cells = q.select(qid, l2_normalize(qvec).alias("_q")).mapInPandas(
        _nearest_cells(bc, "_q", probe, [qid]), f"{qid} {typ}, cell int").select("cell").distinct()
    # at most one row a cell; the filter prunes the partitions of cells nobody probes
    rows = probed_rows(store, [r["cell"] for r in cells.collect()])
    hits = ivf_search(rows.select(store.item, "_u", "cell"), store.centroids, q, k, probe, qid, qvec, store.item, threshold)
    keep = [c for c in store.rows.columns if c not in (store.item, "_u", "cell")]
    return hits if not keep else hits.join(store.rows.select(store.item, *keep), store.item)
