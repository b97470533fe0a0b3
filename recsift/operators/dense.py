"""Dense retrieval: L2 normalisation, exact top-k by block matrix products,
threshold search, pairwise similarity and an IVF (cell-pruned) index
(F12, F13, J5, D14-D17, T1).

Exact scoring of Q queries against N items is Q×N dot products; it is never
done as a row-per-pair cross join. Two physical strategies:

* **broadcast queries** when the query block is proven small
  (count × dim × 8 bytes ≤ ``BROADCAST_BYTES``): item partitions are scanned
  once with ``mapInPandas``; each Arrow batch is one matrix product, and only
  the per-query top-k (ties kept) leaves the task;
* **block grid** otherwise: queries are hashed into QB blocks and items into
  IB blocks, each query row is replicated to the IB item blocks and each item
  to the QB query blocks, and ``cogroup(...).applyInPandas`` multiplies one
  (query block, item block) pair per group. Group sizes are bounded by the
  block sizes, whatever the data size. The block numbers of both sides are ints: a
  cogroup does not align key types, and an int and a long hash to different partitions.

Candidates then meet in a ``row_number() <= k`` per query (partial
WindowGroupLimit before the shuffle), after rounding the scores, so ties are
broken by item id identically on every engine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.memory import giving_back
from ..session import stable
from .lexical import top_k
from .vectorfiles import FILE_BYTES, HOLD_BYTES, read_columns, write_files

BROADCAST_BYTES = 256 << 20
QUERY_BLOCK_ROWS = 4096
ITEM_BLOCK_ROWS = 32768
SCORE_ROWS = 512     # queries scored against a block at once
RECALL_QUERIES = 1000   # queries on which recall is measured
SCORE_ITEMS = 4096   # items of a cell file scored at once
FIRST_ITEMS = 256    # and of those met first
NEAREST_ROWS = 1 << 20  # (row, cell) pairs looked at at once
DIGITS = 6           # decimal places of a score in rankings


# ------------------------------------------------------------------ F12 / F13
def _c(col):
    return F.col(col) if isinstance(col, str) else col


def norm(col: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(col), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x))


def l2_normalize(col: str | Column) -> Column:
    """Unit vector as array<double>; a zero vector stays zero."""
    n = norm(col)
    return F.transform(_c(col), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ numpy side
def _matrix(series: pd.Series, unit: bool) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    m = np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])
    if unit:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return m


def round_half_up(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """The rounding of Spark's ``round`` for doubles; every ranking uses rounded scores."""
    scale = 10.0 ** digits
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale


def _first_k(q: np.ndarray, it: np.ndarray, s: np.ndarray, k: int | None):
    """Exactly the first ``k`` of each query by (score desc, item asc): a total order, so
    no block can lose a row of the final answer and none keeps more."""
    if k is None or len(q) == 0:
        return q, it, s
    code = lambda x: np.unique(x, return_inverse=True)[1] if x.dtype == object else x
    order = np.lexsort((code(it), -s, code(q)))
    q, it, s = q[order], it[order], s[order]
    starts = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1]
    sizes = np.diff(np.r_[starts, len(q)])
    keep = np.arange(len(q)) - np.repeat(starts, sizes) < k
    return q[keep], it[keep], s[keep]


def _score_block(qids, qm, iids, im, k, min_score, out, sub=SCORE_ROWS):
    """(query, item, rounded score) of one block: at most ``k`` rows a query; with
    ``min_score`` only pairs whose exact score reaches it."""
    order = np.argsort(iids, kind="stable")
    iids, im = iids[order], im[order]
    qs, its, ss = [], [], []
    for lo in range(0, len(qids), sub):
        exact = qm[lo:lo + sub] @ im.T
        s = round_half_up(exact)
        keep = np.ones(s.shape, dtype=bool) if min_score is None else exact >= min_score
        if k is not None and s.shape[1] > k:
            s = np.where(keep, s, -np.inf)
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
            above, tied = s > kth, s == kth
            # columns are in item order: the smallest ids among the tied fill up
            room = k - above.sum(axis=1, keepdims=True)
            keep &= above | (tied & (np.cumsum(tied, axis=1) <= room))
        r, c = np.nonzero(keep)
        qs.append(qids[lo + r])
        its.append(iids[c])
        ss.append(s[r, c])
    if not qs:
        return pd.DataFrame({out[0]: [], out[1]: [], out[2]: []})
    return pd.DataFrame({out[0]: np.concatenate(qs), out[1]: np.concatenate(its), out[2]: np.concatenate(ss)})


# ------------------------------------------------------------------ D14 / T1
def _spread(df: DataFrame) -> DataFrame:
    """Deal the scanned side to two partitions per core (the work is queries × items,
    so parallelism must not depend on the file layout)."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 2)


def _broadcast_queries(q, i, qid, item, k, min_score, unit, schema):
    """Few queries: ship them; each item partition keeps per query its own top k."""
    spark = q.sparkSession
    qpdf = q.toPandas()  # size checked by the caller
    bc = spark.sparkContext.broadcast((qpdf[qid].to_numpy(), _matrix(qpdf["_v"], unit)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qm = bc.value
        best = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            got = _score_block(qids, qm, pdf[item].to_numpy(), _matrix(pdf["_v"], unit), k, min_score,
                               (qid, item, "score"))
            if k is None:
                yield got
                continue
            # at most k rows a query are held between batches
            best = got if best is None else pd.concat([best, got], ignore_index=True)
            cols = _first_k(best[qid].to_numpy(), best[item].to_numpy(), best["score"].to_numpy(), k)
            best = pd.DataFrame(dict(zip((qid, item, "score"), cols)))
        if best is not None:
            yield best

    return _spread(i).mapInPandas(scan, schema)


def _broadcast_items(q, i, qid, item, k, min_score, unit, schema):
    """Few items: ship them; every query is scored completely in one task."""
    spark = q.sparkSession
    ipdf = i.toPandas()  # size checked by the caller
    bc = spark.sparkContext.broadcast((ipdf[item].to_numpy(), _matrix(ipdf["_v"], unit)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        iids, im = bc.value
        for pdf in batches:
            qids, qm = pdf[qid].to_numpy(), _matrix(pdf["_v"], unit)
            for at in range(0, len(pdf), SCORE_ROWS):
                best = None
                for lo in range(0, len(iids), ITEM_BLOCK_ROWS):   # bounds the score matrix
                    got = _score_block(qids[at:at + SCORE_ROWS], qm[at:at + SCORE_ROWS], iids[lo:lo + ITEM_BLOCK_ROWS],
                                       im[lo:lo + ITEM_BLOCK_ROWS], k, min_score, (qid, item, "score"))
                    if k is None:
                        yield got
                        continue
                    best = got if best is None else pd.concat([best, got], ignore_index=True)
                    cols = _first_k(best[qid].to_numpy(), best[item].to_numpy(), best["score"].to_numpy(), k)
                    best = pd.DataFrame(dict(zip((qid, item, "score"), cols)))
                if best is not None:
                    yield best

    return _spread(q).mapInPandas(scan, schema)


def dense_candidates(queries: DataFrame, items: DataFrame, k: int | None, qid: str = "qid", qvec: str = "vec",
                     item: str = "item_id", ivec: str = "vec", unit: bool = True, min_score: float | None = None,
                     strategy: str = "auto", query_block: int | None = None,
                     item_block: int | None = None) -> DataFrame:
    """(qid, item, score) rows: a superset of each query's first k by (rounded score
    desc, item asc), at most k from every block; k=None keeps every pair whose score
    reaches ``min_score``. One of the two is required."""
    if k is None and min_score is None:
        raise ValueError("all pairs without k or min_score is an N x M table")
    spark = queries.sparkSession
    qtypes, itypes = dict(queries.dtypes), dict(items.dtypes)
    schema = f"{qid} {qtypes[qid]}, {item} {itypes[item]}, score double"
    # both sides are counted, sized and then scanned: materialise them once
    # (rows without a vector cannot be scored and are left out)
    q = stable(queries.select(qid, F.col(qvec).alias("_v")).filter(F.col("_v").isNotNull()))
    i = stable(items.select(item, F.col(ivec).alias("_v")).filter(F.col("_v").isNotNull()))
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    nq, dim = int(stats["n"]), int(stats["d"] or 0)
    if nq == 0:
        return spark.createDataFrame([], schema)
    ni = i.count()
    small = min(nq, ni) * max(dim, 1) * 8
    if strategy == "broadcast" or (strategy == "auto" and small <= BROADCAST_BYTES):
        if nq <= ni:
            return _broadcast_queries(q, i, qid, item, k, min_score, unit, schema)
        return _broadcast_items(q, i, qid, item, k, min_score, unit, schema)

    qb = max(1, math.ceil(nq / (query_block or QUERY_BLOCK_ROWS)))
    ib = max(1, math.ceil(ni / (item_block or ITEM_BLOCK_ROWS)))
    qx = q.withColumn("_qb", F.pmod(F.xxhash64(qid), F.lit(qb)).cast("int")).withColumn("_ib", F.explode(F.sequence(F.lit(0), F.lit(ib - 1))))
    ix = i.withColumn("_ib", F.pmod(F.xxhash64(item), F.lit(ib)).cast("int")).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def grid(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({qid: [], item: [], "score": []})
        return _score_block(left[qid].to_numpy(), _matrix(left["_v"], unit), right[item].to_numpy(),
                            _matrix(right["_v"], unit), k, min_score, (qid, item, "score"))

    return qx.groupBy("_qb", "_ib").cogroup(ix.groupBy("_qb", "_ib")).applyInPandas(grid, schema)


def dense_rank(queries: DataFrame, items: DataFrame, k: int = 100, qid: str = "qid", qvec: str = "vec",
               item: str = "item_id", ivec: str = "vec", strategy: str = "auto", query_block: int | None = None,
               item_block: int | None = None) -> DataFrame:
    """Exact top-k items per query by cosine (scores rounded to 6 places,
    ties by item id), whatever the layout, strategy and block sizes."""
    cand = dense_candidates(queries, items, k, qid, qvec, item, ivec, True, None, strategy, query_block, item_block)
    return top_k(cand, qid, item, k)


def threshold_search(queries: DataFrame, index: DataFrame, threshold: float = 0.6, k: int = 5, qid: str = "qid",
                     qvec: str = "vec", item: str = "item_id", ivec: str = "vec") -> DataFrame:
    """Per query the best ≤ k index rows with cosine ≥ threshold, best
    first, ties by id (the threshold is applied before the top-k, R3)."""
    cand = dense_candidates(queries, index, k, qid, qvec, item, ivec, True, threshold)
    return top_k(cand, qid, item, k)


def similarity_table(a: DataFrame, b: DataFrame, aid: str, avec: str, bid: str, bvec: str,
                     k: int | None = None, min_score: float | None = None) -> DataFrame:
    """D15 (N×M form): the (a, b) cosines of each a's best ``k`` b and / or of all pairs at or
    above ``min_score`` (one is required: the full table has N×M rows). Use
    :func:`aligned_similarity` for pairs."""
    cand = dense_candidates(a, b, k, aid, avec, bid, bvec, True, min_score)
    return cand if k is None else top_k(cand, aid, bid, k).drop("rank")


def aligned_similarity(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """D15 (paired form): cosine of two vector columns on each row."""
    return df.withColumn(out, cosine(a, b))


# ------------------------------------------------------------------------ D17
def _probes(unit: np.ndarray, cents: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` cells of highest inner product of each unit vector, best first."""
    return np.argsort(-(unit @ cents.T), axis=1, kind="stable")[:, :n]


def _nearest_cells(bc, vec_col: str, n: int, keep: list[str], cell: str = "cell"):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cents = bc.value
        take = min(n, cents.shape[0])
        step = max(1, NEAREST_ROWS // cents.shape[0])      # bounds the scores and what is handed on at once
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step]
                top = _probes(_matrix(part[vec_col], True), cents, take)
                out = part.iloc[np.repeat(np.arange(len(part)), take)][keep].reset_index(drop=True)
                out[cell] = top.reshape(-1).astype("int32")
                yield out
    return run


def build_ivf(items: DataFrame, item: str = "item_id", vec: str = "vec", n_cells: int = 100, seed: int = 42,
              max_iter: int = 10):
    """D17 index: k-means cells (``pyspark.ml``, distributed) over unit
    vectors, cells = min(n_cells, N); every item goes to its highest-inner-
    product centroid. Returns (assignments DataFrame, centroid matrix).
    The centroid matrix is n_cells × dim: bounded by a parameter."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = items.sparkSession
    unit = stable(items.select(item, l2_normalize(vec).alias("_u")))
    n = unit.count()
    cells = max(1, min(n_cells, n))
    feats = unit.select(array_to_vector("_u").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, initMode="k-means||").fit(feats)
    cents = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    nrm = np.linalg.norm(cents, axis=1, keepdims=True)
    cents = np.divide(cents, nrm, out=np.zeros_like(cents), where=nrm > 0)
    bc = spark.sparkContext.broadcast(cents)
    typ = dict(items.dtypes)[item]
    assign = unit.mapInPandas(_nearest_cells(bc, "_u", 1, [item, "_u"]), f"{item} {typ}, _u array<double>, cell int")
    return stable(assign), cents


def add_to_ivf(assign: DataFrame, centroids: np.ndarray, new_rows: DataFrame, item: str = "item_id",
               vec: str = "vec") -> DataFrame:
    """U3 for the cell index: new rows join their nearest cells (ids must stay unique)."""
    bc = new_rows.sparkSession.sparkContext.broadcast(centroids)
    typ = dict(new_rows.dtypes)[item]
    more = new_rows.filter(F.col(vec).isNotNull()).select(item, l2_normalize(vec).alias("_u")).mapInPandas(
        _nearest_cells(bc, "_u", 1, [item, "_u"]), f"{item} {typ}, _u array<double>, cell int")
    return stable(assign.unionByName(more))


def ivf_search(assign: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, n_probe: int = 10,
               qid: str = "qid", qvec: str = "vec", item: str = "item_id", threshold: float | None = None,
               file_bytes: int = FILE_BYTES, hold_bytes: int = HOLD_BYTES) -> DataFrame:
    """D17 search: each query visits its ``n_probe`` best cells and is scored
    exactly against the items there; the top k are kept. With ``n_probe`` =
    number of cells this equals exact search; with ``threshold`` only items whose
    cosine reaches it count.

    The items are stored by cell in files of at most about ``file_bytes``, and a task takes queries worth
    about ``hold_bytes`` (vectors, probed cells, results) through files one by one, scoring each against the cells it
    probes and keeping its first ``k`` so far. Few queries meet the files in several tasks, each with a share
    of the files; queries are repeated for that at most twice a core. No vector is repeated for a cell."""
    spark, n_cells = queries.sparkSession, centroids.shape[0]
    qtyp, ityp = dict(queries.dtypes)[qid], dict(assign.dtypes)[item]
    probe, tasks = min(n_probe, n_cells), spark.sparkContext.defaultParallelism * 2
    schema = f"{qid} {qtyp}, {item} {ityp}, score double"
    q = stable(queries.filter(F.col(qvec).isNotNull()).select(qid, l2_normalize(qvec).alias("_q")))
    n_queries = q.count()
    stats = assign.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_u")).alias("d")).first()
    if not n_queries or not stats["n"]:
        return top_k(spark.createDataFrame([], schema), qid, item, k)
    width = int(stats["d"]) * 8
    n_files = max(1, math.ceil(int(stats["n"]) * (width + 100) / file_bytes))
    files = write_files(assign.select(item, "_u", "cell").repartitionByRange(n_files, "cell", item), "cells")
    most = max(1, hold_bytes // (width + k * 32 + (probe * 16 if probe < n_cells else 0)))   # queries that a task holds
    shares = min(len(files), math.ceil(tasks / math.ceil(n_queries / most)))
    groups = max(math.ceil(n_queries / most), math.ceil(tasks / shares))
    dealt = q.withColumn("_g", F.pmod(F.xxhash64(qid), F.lit(groups)).cast("int")) \
        .withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartitionByRange(groups * shares, "_h", "_g")
    bc = spark.sparkContext.broadcast(centroids)

    def search(qids: np.ndarray, qm: np.ndarray, mine: list[str]) -> pd.DataFrame:
        best, ids_of = np.full((len(qids), k), -np.inf), np.empty((len(qids), k), dtype=object)
        every = np.arange(len(qids))
        if probe < n_cells:
            step = max(1, NEAREST_ROWS // n_cells)
            cells = np.concatenate([_probes(qm[lo:lo + step], bc.value, probe).astype(np.int32) for lo in range(0, len(qm), step)]).reshape(-1)
            by_cell = np.argsort(cells, kind="stable")
            starts = np.searchsorted(cells[by_cell], np.arange(n_cells + 1))
            who = (by_cell // probe).astype(np.int32)
            del cells, by_cell
        for path in mine:
            in_cell, = read_columns(path, "cell")
            if probe < n_cells and not any(starts[c] < starts[c + 1] for c in np.unique(in_cell)):
                continue
            in_cell, ids, vectors = read_columns(path, "cell", item, "_u")
            if probe == n_cells:
                _keep_best(qm, every, ids, vectors, k, threshold, best, ids_of)
                continue
            for c in np.unique(in_cell):
                rows = who[starts[c]:starts[c + 1]]
                if len(rows):
                    here = in_cell == c
                    _keep_best(qm, rows, ids[here], vectors[here], k, threshold, best, ids_of)
        r, c = np.nonzero(best > -np.inf)
        return pd.DataFrame({qid: qids[r], item: ids_of[r, c], "score": best[r, c]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shared_out() -> Iterator[pd.DataFrame]:
            qids, share, qm = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for h in np.unique(share):
                yield search(qids[share == h], qm[share == h], files[h::shares])

        held, size = [], 0
        for pdf in batches:
            for lo in range(0, len(pdf), most):
                part = pdf.iloc[lo:lo + most]
                if size + len(part) > most and held:
                    yield from shared_out()
                    size = 0
                held.append((part[qid].to_numpy(), part["_h"].to_numpy(), _matrix(part["_q"], False)))
                size += len(part)
        if held:
            yield from shared_out()

    cand = dealt.select(qid, "_h", "_q").mapInPandas(giving_back(run), schema)
    return top_k(cand, qid, item, k)


def _keep_best(qm: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, min_score: float | None,
               best: np.ndarray, ids_of: np.ndarray) -> None:
    """Puts into ``best`` and ``ids_of`` (the first ``k`` scores and items so far, by score and item) of the queries ``rows`` what
    belongs there of these items; with ``min_score`` only items whose exact score reaches it."""
    lo = 0
    while lo < len(ids):
        # the first items are few: they give a bound that most of the others miss
        hi = lo + (FIRST_ITEMS if lo == 0 else SCORE_ITEMS)
        block, others = ids[lo:hi], vectors[lo:hi]
        for at in range(0, len(rows), SCORE_ROWS):
            mine = rows[at:at + SCORE_ROWS]
            exact = qm[mine] @ others.T
            keep = exact >= best[mine, -1, None] - 10.0 ** -DIGITS      # a rounded score is less than that away
            if min_score is not None:
                keep &= exact >= min_score
            r, c = np.nonzero(keep)
            if not len(r):
                continue
            new = np.unique(r)
            was = best[mine[new]]
            o, p = np.nonzero(was > -np.inf)
            row, it, s = _first_k(np.concatenate([r, new[o]]), np.concatenate([block[c], ids_of[mine[new]][o, p].astype(block.dtype)]),
                                  np.concatenate([round_half_up(exact[r, c]), was[o, p]]), k)
            first = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1]
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
            best[mine[row], place], ids_of[mine[row], place] = s, it
        lo = hi


def probes_for_recall(assign: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, target: float = 0.9,
                      sample: int = RECALL_QUERIES, qid: str = "qid", qvec: str = "vec", item: str = "item_id",
                      seed: int = 42) -> int:
    """The smallest number of cells to probe at which recall@k against exact search reaches
    ``target``. At most ``sample`` queries (by hash) are searched exactly over all items, and each true
    neighbour is found as soon as its cell is probed; when there are more queries, two standard
    errors of the mean are left as margin."""
    some = stable(queries.select(qid, qvec).orderBy(F.xxhash64(F.col(qid), F.lit(seed)), qid).limit(sample))
    rows = some.toPandas()
    if not len(rows):
        return 1
    true = dense_rank(some, assign.select(item, F.col("_u").alias("vec")), k, qid=qid, qvec=qvec, item=item, ivec="vec")
    true = true.select(qid, item).join(assign.select(item, "cell"), item).select(qid, "cell").toPandas()
    order = np.argsort(-(_matrix(rows[qvec], True) @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)          # of each cell, by query
    at = place[pd.Index(rows[qid]).get_indexer(true[qid]), true["cell"].to_numpy()]
    for n_probe in range(1, centroids.shape[0]):
        found = pd.Series(at < n_probe, dtype=float).groupby(true[qid].to_numpy()).mean()
        margin = 2 * found.std(ddof=0) / math.sqrt(len(found)) if len(rows) == sample else 0.0
        if found.mean() - margin >= target:
            return n_probe
    return centroids.shape[0]


# ------------------------------------------------------------------ J9 / D16 / U3
def align_vectors(id_map: DataFrame, vectors: DataFrame, dim: int, id_col: str = "id", vec_col: str = "vec",
                  row_col: str = "row", first_id: int = 1, pad_id: int | None = 0) -> DataFrame:
    """Vectors matched to ids by position (file row r belongs to id
    r + first_id); ids without a row, and the pad id, get a zero vector.
    An equi-join on the computed id, never a positional zip."""
    keyed = vectors.select((F.col(row_col) + F.lit(first_id)).alias(id_col), F.col(vec_col).alias("_v"))
    ids = id_map.select(id_col, *[c for c in id_map.columns if c != id_col])
    if pad_id is not None:
        pad = id_map.sparkSession.createDataFrame([(pad_id,)], f"{id_col} long")
        ids = ids.unionByName(pad, allowMissingColumns=True)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (ids.join(keyed, id_col, "left")
            .withColumn(vec_col, F.coalesce(F.col("_v").cast("array<float>"), zeros)).drop("_v"))


def build_index(df: DataFrame, id_col: str, text_col: str, encoder_factory=None, out: str = "embedding") -> DataFrame:
    """An index table (id, text, unit embedding) from text; the encoder
    runs per Arrow batch (see :func:`..operators.embed.embed_text`)."""
    from .embed import HashEncoder, embed_text

    emb = embed_text(df.select(id_col, text_col), text_col, "_e", encoder_factory or HashEncoder)
    return emb.select(id_col, text_col, l2_normalize("_e").alias(out))


def add_to_index(index: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Append encoded rows to an index table (ids must stay unique)."""
    return index.unionByName(new_rows)
