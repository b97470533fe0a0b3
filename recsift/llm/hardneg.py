"""Hard-negative mining over an inverted multi-index.

*Index.* A vector is cut into two halves; each half has its own codebook of ``CODES`` centres
(Lloyd rounds over a bounded sample, ``SAMPLE_ROWS`` by hash: it only decides how well cells
prune). The pair of nearest centres is the vector's cell; every vector is indexed. A centre's
radius is the largest distance of any indexed half to it.

*Search.* By Cauchy-Schwarz no vector of cell (i, j) scores more than

    q1 . c1[i] + |q1| r1[i]  +  q2 . c2[j] + |q2| r2[j]

with an anchor (q1, q2). The multi-sequence heap visits cells in the order of these sums: both
half-score lists are sorted, and a cell enters the heap when its two predecessors were visited.
Anchors visit their next cells in rounds (``FIRST_ROWS`` rows of the index, then
``GROWTH`` times as many each round); an anchor stops as soon as its windows are certified: no cell still to come can
reach the last wanted score, or the lower end of the window. The first search finds the
positives, the second one the negatives of all positives at once. Nothing is approximate.

Cells are cut into parts of at most about ``PART_ROWS`` rows and a cell's anchors into groups
of ``ANCHOR_ROWS``, so neither a crowded cell nor a cell that all anchors visit meets in one task;
a part and a group meet in one matrix product, of which only the first rows of every window leave.

Defined cases: rows with a null id or label, a null or empty vector, a null or non-finite
component, or another dimension than the most frequent one (the smaller of equally frequent
ones) take no part; of several rows with one id the one with the smallest (label, vector)
counts, so repeated rows count once; ties of scores go to smaller ids; an anchor without
positives or a positive without negatives gives no rows; an empty table gives an empty result; other
columns are ignored. Scores are exact while inner products stay below 2**53.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

CODES = 16             # centres of a half; cells = CODES ** 2
SAMPLE_ROWS = 8192     # rows (by hash) the codebooks are fitted on
ROUNDS = 8             # Lloyd rounds
PART_ROWS = 512
ANCHOR_ROWS = 1024
FIRST_ROWS = 2048      # indexed rows an anchor visits in its first round
GROWTH = 8


# ---- vectors ---------------------------------------------------------------------

def clean(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id, label, v``: the rows that take part; v holds ``floor(scale * x)`` as packed doubles.
    ``rows`` has vec_id, label, vec."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                    F.col("vec").cast("array<double>").alias("vec")).filter(usable)
    top = x.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    x = x.filter(F.size("vec") == (top["d"] if top else 0))
    one = x.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.label", "x.vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.floor(scale * b.column(2).flatten().to_numpy(zero_copy_only=False))
            m = flat.reshape(b.num_rows, -1) if b.num_rows else flat.reshape(0, 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in m], pa.binary())],
                                             names=["vec_id", "label", "v"])

    return one.mapInArrow(run, "vec_id long, label long, v binary")


def _matrix(vectors) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    vectors = [bytes(v) for v in vectors]
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1) if vectors else np.zeros((0, 0))


# ---- codebooks -------------------------------------------------------------------

def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * (m @ centres.T), axis=1)


def fit_codebook(m: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd rounds from evenly spaced different rows."""
    different = np.unique(m, axis=0)
    centres = different[np.linspace(0, len(different) - 1, min(codes, len(different))).astype(int)]
    for _ in range(rounds):
        near = _nearest(m, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Index:
    """``cells``: vec_id, label, v, cell, part. What searching needs beside it is bounded by
    ``CODES``: two codebooks, their radii, the rows of each cell."""

    def __init__(self, cells: DataFrame, books, radii, sizes: dict[int, int]):
        self.cells, self.books, self.radii, self.sizes = cells, books, radii, sizes


def build(vectors: DataFrame, codes: int = CODES, sample_rows: int = SAMPLE_ROWS) -> Index | None:
    """The index over all rows of ``vectors`` (vec_id, label, v); None for an empty table."""
    n = vectors.count()
    if n == 0:
        return None
    # a counted share by hash, twice the bound at most, then cut: no sort of the table
    share = min(1.0, 2 * sample_rows / n)
    picked = vectors.select("v", F.xxhash64("vec_id").alias("h")).filter(
        F.pmod("h", F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).orderBy("h").limit(sample_rows)
    sample = _matrix(r["v"] for r in picked.select("v").collect())
    cut = sample.shape[1] // 2
    books = (fit_codebook(sample[:, :cut], codes), fit_codebook(sample[:, cut:], codes))
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(2).to_pylist())
            if not len(m):
                continue
            near, far = [], []
            for half, book in zip((m[:, :cut], m[:, cut:]), sent.value):
                code = _nearest(half, book)
                near.append(code)
                far.append(np.linalg.norm(half - book[code], axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c.astype(np.int32)) for c in near), *(pa.array(f) for f in far)],
                                             names=["vec_id", "label", "v", "c1", "c2", "f1", "f2"])

    dealt = materialise(vectors.mapInArrow(run, "vec_id long, label long, v binary, c1 int, c2 int, f1 double, f2 double"),
                        "multi-index")
    counts = dealt.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("f1").alias("f1"), F.max("f2").alias("f2")).collect()
    radii = (np.zeros(len(books[0])), np.zeros(len(books[1])))
    for r in counts:     # at most codes ** 2 rows
        radii[0][r["c1"]] = max(radii[0][r["c1"]], r["f1"])
        radii[1][r["c2"]] = max(radii[1][r["c2"]], r["f2"])
    width = len(books[1])
    sizes = {r["c1"] * width + r["c2"]: r["n"] for r in counts}
    cells = dealt.select("vec_id", "label", "v", (F.col("c1") * width + F.col("c2")).alias("cell"))
    return Index(cells, books, radii, sizes)


# ---- the heap --------------------------------------------------------------------

def half_bounds(q: np.ndarray, books, radii) -> tuple[np.ndarray, np.ndarray]:
    """The most a vector's halves can score, by centre; widened against rounding."""
    cut = books[0].shape[1]
    out = []
    for half, book, radius in zip((q[:cut], q[cut:]), books, radii):
        bound = book @ half + np.linalg.norm(half) * radius
        out.append(bound + 1e-9 * (np.abs(bound) + np.linalg.norm(half) * (radius + np.linalg.norm(book, axis=1))) + 1e-6)
    return out[0], out[1]


def multi_sequence(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, float]]:
    """Cells and their bounds ``u[i] + v[j]`` from the highest bound to the lowest."""
    a, b = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    heap, visited = [(-(u[a[0]] + v[b[0]]), 0, 0)], set()
    while heap:
        bound, i, j = heapq.heappop(heap)
        visited.add((i, j))
        yield int(a[i]) * len(v) + int(b[j]), -bound
        # a cell enters when both predecessors were visited
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x == 0 or (x - 1, y) in visited) and (y == 0 or (x, y - 1) in visited):
                heapq.heappush(heap, (-(u[a[x]] + v[b[y]]), x, y))


def next_cells(q: np.ndarray, books, radii, sizes: dict[int, int], done: int, rows: int) -> tuple[list[int], int, float]:
    """After ``done`` visited cells: the next non-empty cells with about ``rows`` indexed rows, the
    number visited then, and the bound of the first cell still to come (-inf: none)."""
    taken, seen, got = [], 0, 0
    for cell, bound in multi_sequence(*half_bounds(q, books, radii)):
        if not sizes.get(cell):
            continue
        if seen >= done and got >= rows:
            return taken, seen, bound
        if seen >= done:
            taken.append(cell)
            got += sizes[cell]
        seen += 1
    return taken, seen, -math.inf


# ---- rounds ----------------------------------------------------------------------

def _first_rows(scores: np.ndarray, keep: np.ndarray, k: int) -> np.ndarray:
    """Columns of the first ``k`` of ``keep`` by score, then place (columns ascend by id)."""
    at = np.flatnonzero(keep)
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _visit(index: Index, open_: DataFrame, k: int, rows: int, negatives: bool) -> tuple[DataFrame, DataFrame]:
    """One round for the anchors of ``open_`` (anchor_id, label, v, done, lo, hi): the windows' first
    ``k`` rows among the next cells (anchor_id, w, vec_id, score), and anchor_id, done, bound."""
    spark = open_.sparkSession
    sent = spark.sparkContext.broadcast((index.books, index.radii, index.sizes))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1).to_pylist())
            for anchor, q, done in zip(b.column(0).to_pylist(), m, b.column(2).to_pylist()):
                cells, seen, bound = next_cells(q, *sent.value, done, rows)
                yield pa.RecordBatch.from_pydict({
                    "anchor_id": pa.array([anchor], pa.int64()), "cells": pa.array([cells], pa.list_(pa.int32())),
                    "done": pa.array([seen], pa.int32()), "bound": pa.array([bound], pa.float64())})

    walked = materialise(open_.select("anchor_id", "v", "done").mapInArrow(
        walk, "anchor_id long, cells array<int>, done int, bound double"), "multi-visits")
    n = max(open_.count(), 1)
    groups = math.ceil(n / ANCHOR_ROWS)
    parts = {c: math.ceil(s / PART_ROWS) for c, s in index.sizes.items()}     # one entry a cell
    n_parts = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("cell"))
    asked = walked.select("anchor_id", F.explode("cells").alias("cell")).join(
        open_.select("anchor_id", "label", "v", "lo", "hi"), "anchor_id")
    asked = asked.withColumn("g", F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    items = index.cells.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int")) \
        .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
            scores = _matrix(left["v"]) @ _matrix(right["v"]).T
            lows, highs = np.stack(left["lo"].to_list()), np.stack(left["hi"].to_list())
            for i, (anchor, label) in enumerate(zip(left["anchor_id"], left["label"])):
                s = scores[i]
                group = labels != label if negatives else (labels == label) & (ids != anchor)
                inside = group & (100 * s >= lows[i][:, None]) & (100 * s <= highs[i][:, None])
                for w in np.flatnonzero(inside.any(axis=1)).tolist():
                    out += [(anchor, w, ids[c], s[c]) for c in _first_rows(s, inside[w], k)]
        return pd.DataFrame(out, columns=["anchor_id", "w", "vec_id", "score"])

    keys = ["cell", "part", "g"]
    found = asked.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInPandas(
        meet, "anchor_id long, w int, vec_id long, score double")
    return found, walked.select("anchor_id", "done", "bound")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every window; a window has at most ``k`` rows from each part."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    # two levels: no task gathers more than a share of a window's rows
    for keys in (["anchor_id", "w", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("__d")], ["anchor_id", "w"]):
        found = found.groupBy(*keys).agg(F.slice(order, 1, k).alias("x")).select(
            "anchor_id", "w", F.explode("x").alias("x")).select("anchor_id", "w", "x.vec_id", (-F.col("x.s")).alias("score"))
    return found


def search(index: Index, anchors: DataFrame, k: int, negatives: bool) -> DataFrame:
    """``anchor_id, w, vec_id, score``: for each anchor (anchor_id, label, v, lo, hi) and window w the
    first ``k`` rows of its label (``negatives``: of other labels) with ``lo[w] <= 100 * score <= hi[w]``."""
    open_ = materialise(anchors.withColumn("done", F.lit(0)), "multi-open")
    kept, rows = None, FIRST_ROWS
    while not open_.isEmpty():
        found, walked = _visit(index, open_, k, rows, negatives)
        found = found if kept is None else found.unionByName(kept)
        kept = materialise(_best(found, k), "multi-kept")
        # a window is certified if no cell to come reaches its last wanted score or its lower end
        full = kept.groupBy("anchor_id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")) \
            .filter(F.col("n") >= k)
        last = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("last"))
        x = open_.drop("done").join(walked, "anchor_id").join(last, "anchor_id", "left")
        # only rows that reach the last wanted score still matter
        reach = F.transform("lo", lambda lo, w: F.greatest(lo, 100 * F.coalesce(F.try_element_at("last", w), F.lit(-math.inf))))
        x = x.withColumn("lo", reach)
        to_come = F.exists("lo", lambda lo: (100 * F.col("bound") >= lo) & (F.col("bound") > F.lit(-math.inf)))
        open_ = materialise(x.filter(to_come).select("anchor_id", "label", "v", "lo", "hi", "done"), "multi-open")
        rows *= GROWTH
    if kept is None:
        return index.cells.sparkSession.createDataFrame([], "anchor_id long, w int, vec_id long, score double")
    return kept


def mine(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
         scale: float = 256.0, codes: int = CODES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row
    that ``anchor`` picks and each of its first ``n_positives`` other rows of the same label, the
    first ``n_negatives`` rows of other labels with ``low * p <= 100 * score <= high * p``.
    ``rows`` has vec_id, label, vec."""
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vectors = materialise(clean(rows, scale), "multi-vectors")
    index = build(vectors, codes)
    if index is None:
        return spark.createDataFrame([], schema)
    anchors = vectors.filter(anchor).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    everything = F.array(F.lit(-math.inf)), F.array(F.lit(math.inf))
    positives = search(index, anchors.withColumns({"lo": everything[0], "hi": everything[1]}), n_positives, False)
    # windows of an anchor: its positives by (score desc, id)
    listed = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), "vec_id"))).alias("p"))
    listed = materialise(listed, "multi-positives")
    windows = anchors.join(listed, "anchor_id").select(
        "anchor_id", "label", "v", F.transform("p", lambda p: -low * p["s"]).alias("lo"),
        F.transform("p", lambda p: -high * p["s"]).alias("hi"))
    negatives = search(index, windows, n_negatives, True)
    each = negatives.groupBy("anchor_id", "w").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), "vec_id"))).alias("n"))
    x = each.join(listed, "anchor_id").select("anchor_id", F.get("p", F.col("w")).alias("p"), F.posexplode("n").alias("i", "n"))
    return x.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("i") + 1).cast("int").alias("rank"),
                    F.col("n.vec_id").alias("negative_id"), (-F.col("p.s")).cast("long").alias("positive_score"),
                    (-F.col("n.s")).cast("long").alias("negative_score"))
