"""Next-item evaluation (D20): score every item for each evaluation row and
report Recall/NDCG at the cutoffs.

The item vectors are stored once, in files of bounded size, which the tasks open themselves and hold one at a
time: neither the driver nor a worker ever holds the item table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np
import pandas as pd

from ..functions.memory import give_back, giving_back
from ..session import stable, stored
from .dense import SCORE_ROWS, _matrix, _spread, round_half_up
from .embed import mean_pool
from .metrics import with_metrics
from .vectorfiles import FILE_BYTES, HOLD_BYTES, read_columns, write_files

SCORE_ITEMS = 2048           # items scored against SCORE_ROWS rows at once
GATHER_ROWS = 32768          # item vectors copied at once


def history_mean_vectors(rows: DataFrame, row_key: str, history: str, item_vecs: DataFrame, item: str,
                         vec: str) -> DataFrame:
    """Built-in user vector: mean of the history items' vectors (history
    length is bounded by the truncation, so each group is bounded)."""
    exploded = rows.select(row_key, F.explode(history).alias(item))
    joined = exploded.join(item_vecs.select(item, vec), item)
    return mean_pool(joined, row_key, vec, out="user_vec")


# ------------------------------------------------------------------ stored items
def _store_items(item_vecs: DataFrame, item: str, vec: str, file_bytes: int) -> tuple[list[str], int]:
    """Files of at most about ``file_bytes`` with ``item`` and ``_v`` (array<double>), and the vectors' width. The first file
    is a hash share of the items, the others are ranges of item ids."""
    items = stored(item_vecs.select(item, F.col(vec).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull() & F.col(item).isNotNull()))
    stats = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    dim = max(int(stats["d"] or 0), 1)
    files = max(1, math.ceil(int(stats["n"]) * (dim * 8 + 100) / file_bytes))
    share = F.pmod(F.xxhash64(item), F.lit(files))
    parts = [items.filter(share == 0).repartition(1)]
    if files > 1:
        parts.append(items.filter(share > 0).repartitionByRange(files - 1, item))
    return [f for part in parts for f in write_files(part, "items")], dim


def _load_items(path: str, item: str, dim: int, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids, in order, and vectors of one file."""
    ids, m = read_columns(path, item, "_v")
    order = np.argsort(ids, kind="stable")
    m = m.reshape(len(ids), dim)[order]
    return ids[order], _unit(m) if unit else m


def _unit(m: np.ndarray) -> np.ndarray:
    """Unit vectors, in place; a zero vector stays zero."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=m, where=n > 0)


# ------------------------------------------------------------------ counting
def _count(ids: np.ndarray, vectors: np.ndarray, users: np.ndarray, score: np.ndarray, wanted: np.ndarray, n: np.ndarray,
           live: np.ndarray, k: int, digits: int, row_block: int, item_block: int) -> np.ndarray:
    """Adds to ``n`` how many of the items stand before each ``live`` row's target; returns the rows still live."""
    n_blocks = math.ceil(len(ids) / item_block)       # every n_blocks-th item, so a block holds ids from everywhere, in order
    for b in range(n_blocks):
        block, others = ids[b::n_blocks], vectors[b::n_blocks]
        place = np.arange(len(block))[None, :]
        for lo in range(0, len(live), row_block):      # bounds the score matrix
            at = live[lo:lo + row_block]
            first = np.searchsorted(block, wanted[at])
            s, mine = round_half_up(users[at] @ others.T, digits), score[at][:, None]
            ahead = (s > mine) | ((s == mine) & (place < first[:, None]))
            there = np.flatnonzero(first < len(block))
            there = there[block[first[there]] == wanted[at[there]]]
            ahead[there, first[there]] = False         # the target itself
            n[at] += ahead.sum(axis=1)
        live = live[n[live] < k]
    return live


def _rank(rows: DataFrame, files: Sequence[str], item: str, dim: int, unit: bool, row_key: str, target: str, k: int, digits: int,
          row_block: int, item_block: int, hold_bytes: int) -> DataFrame:
    """(row, rank) of the open ``rows`` (row, target, ``_u``, ``_s``, ``_n`` items before the target so far) after the
    items of ``files``. A task holds at most about ``hold_bytes`` of user vectors and one file."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rank(held: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            users, score, n = _matrix(pdf["_u"], False), pdf["_s"].to_numpy(), pdf["_n"].to_numpy().copy()
            wanted, keys = pdf[target].to_numpy(), pdf[row_key]
            live = np.flatnonzero(n < k)
            for path in files:
                if not len(live):
                    break
                ids, vectors = _load_items(path, item, dim, unit)
                live = _count(ids, vectors, users, score, wanted, n, live, k, digits, row_block, item_block)
            return pd.DataFrame({row_key: keys.iloc[live], "rank": n[live] + 1})

        most, held, size = max(1, hold_bytes // (dim * 8)), [], 0
        for pdf in batches:
            for lo in range(0, len(pdf), most):
                part = pdf.iloc[lo:lo + most]
                if size + len(part) > most:
                    yield rank(held)
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if held:
            yield rank(held)

    return rows.mapInPandas(giving_back(count), f"{row_key} {dict(rows.dtypes)[row_key]}, rank long")


def evaluate_next_item(user_vecs: DataFrame, item_vecs: DataFrame, targets: DataFrame, row_key: str = "row_id",
                       uvec: str = "user_vec", item: str = "item_id", ivec: str = "vec", target: str = "target",
                       ks: Sequence[int] = (10, 50), metric: str = "cosine", digits: int = 6,
                       row_block: int = SCORE_ROWS, item_block: int = SCORE_ITEMS, pass_bytes: int = FILE_BYTES,
                       hold_bytes: int = HOLD_BYTES) -> DataFrame:
    """The rank of each row's target among all items, by counting.

    The items are stored in files of at most about ``pass_bytes``. A task holds some rows and goes through the files one by one,
    counting, block by block, how many items stand before the target (scores rounded to ``digits``, ties by item
    id). A row with ``max(ks)`` items before its target has no rank whatever follows, so it leaves
    at once, and a task reads files only while rows are open. No row and no item is
    copied to a grid. Rows without a user vector or whose target has no vector have no rank, nor
    do ranks above ``max(ks)``. ``metric``: 'cosine' or 'dot'."""
    unit, k = metric == "cosine", max(ks)
    files, dim = _store_items(item_vecs, item, ivec, pass_bytes)
    own = item_vecs.select(F.col(item).alias(target), F.col(ivec).alias("_t")).filter(F.col("_t").isNotNull())
    asked = targets.select(row_key, target)
    met = user_vecs.select(row_key, F.col(uvec).alias("_u")).filter(F.col("_u").isNotNull()).join(asked, row_key).join(own, target)
    types = dict(met.dtypes)
    schema = f"{row_key} {types[row_key]}, {target} {types[target]}, _u array<double>, _s double, _n long"

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            users, mine = _matrix(pdf["_u"], unit), _matrix(pdf["_t"], unit)
            if len(pdf):
                yield pd.DataFrame({row_key: pdf[row_key], target: pdf[target], "_u": list(users),
                                    "_s": round_half_up(np.einsum("ij,ij->i", users, mine), digits), "_n": 0})

    rows = _spread(met.mapInPandas(prepare, schema))
    ranks = stable(_rank(rows, files, item, dim, unit, row_key, target, k, digits, row_block, item_block, hold_bytes))
    return with_metrics(asked.select(row_key).join(ranks, row_key, "left"), ks)


# ------------------------------------------------------------------ user vectors from histories
def _add_vectors(sums: np.ndarray, owner: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> None:
    """``sums[owner] += vectors[at]`` for repeated owners."""
    order = np.argsort(owner, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, len(owner), GATHER_ROWS):
        o = owner[lo:lo + GATHER_ROWS]
        starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        sums[o[starts]] += np.add.reduceat(vectors[at[lo:lo + GATHER_ROWS]], starts, axis=0)


def _open_rows(rows: DataFrame, files: Sequence[str], item: str, dim: int, unit: bool, row_key: str, history: str, target: str, k: int,
               digits: int, row_block: int, item_block: int, hold_bytes: int) -> DataFrame:
    """Rows still open after the items of the first file, with their user vectors ``_u`` (mean of the history items' vectors),
    the target's score ``_s`` and ``_n``. A task holds at most about ``hold_bytes`` of user vectors (and as much of
    targets' vectors and of item ids) and adds up the vectors of one file after another, so no item vector moves to a row."""
    types = dict(rows.dtypes)
    schema = f"{row_key} {types[row_key]}, {target} {types[target]}, _u array<double>, _s double, _n long"

    def opened(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        rows_here, lists, wanted = len(t), t[history].combine_chunks(), t[target].to_numpy()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        values, owner = lists.flatten(), np.repeat(np.arange(len(t), dtype=np.int32), sizes)
        if values.null_count:
            owner, values = owner[values.is_valid().to_numpy(zero_copy_only=False)], values.drop_null()
        values = values.to_numpy(zero_copy_only=False)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        keys = t[row_key].combine_chunks()
        goal_column = t[target].combine_chunks()
        held.clear()
        del t, lists, order
        asked = np.argsort(wanted, kind="stable")
        goals = wanted[asked]
        sums, mine = np.zeros((rows_here, dim)), np.zeros((rows_here, dim))
        found, known = np.zeros(rows_here, dtype=np.int64), np.zeros(rows_here, dtype=bool)
        ids = vectors = None
        for path in files:
            ids, vectors = _load_items(path, item, dim, False)
            if not len(ids):
                continue
            lo, hi = np.searchsorted(values, ids[0]), np.searchsorted(values, ids[-1], side="right")
            at = np.searchsorted(ids, values[lo:hi])
            hit = ids[at] == values[lo:hi]
            whose = owner[lo:hi][hit]
            found += np.bincount(whose, minlength=rows_here)
            _add_vectors(sums, whose, vectors, at[hit])
            lo, hi = np.searchsorted(goals, ids[0]), np.searchsorted(goals, ids[-1], side="right")
            at = np.searchsorted(ids, goals[lo:hi])
            hit = ids[at] == goals[lo:hi]
            mine[asked[lo:hi][hit]] = vectors[at[hit]]
            known[asked[lo:hi][hit]] = True
        live = np.flatnonzero(known & (found > 0))
        users, mine = sums[live], mine[live]
        del sums, values, owner, vectors
        users /= found[live][:, None]
        give_back()
        if unit:
            users, mine = _unit(users), _unit(mine)
        score, wanted, n = round_half_up(np.einsum("ij,ij->i", users, mine), digits), wanted[live], np.zeros(len(live), dtype=np.int64)
        del mine
        ids, vectors = _load_items(files[0], item, dim, unit)
        still = _count(ids, vectors, users, score, wanted, n, np.arange(len(live)), k, digits, row_block, item_block)
        left = pa.array(live[still])
        u = pa.ListArray.from_arrays(pa.array(np.arange(len(still) + 1, dtype=np.int32) * dim), pa.array(users[still].reshape(-1)))
        return pa.RecordBatch.from_arrays([keys.take(left), goal_column.take(left), u, pa.array(score[still]), pa.array(n[still])],
                                          names=[row_key, target, "_u", "_s", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held, size, ids = max(1, hold_bytes // (dim * 8)), [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                more = len(part.column(history).flatten())
                if held and (size + part.num_rows > most or (ids + more) * 16 > hold_bytes):
                    yield opened(held)
                    size = ids = 0
                held.append(part)
                size, ids = size + part.num_rows, ids + more
        if held:
            yield opened(held)

    return _spread(rows.select(row_key, target, history).filter(F.col(target).isNotNull())).mapInArrow(giving_back(run), schema)


def evaluate_from_histories(rows: DataFrame, item_vecs: DataFrame, row_key: str = "row_id",
                            history: str = "history", target: str = "target", item: str = "item_id",
                            ivec: str = "vec", ks: Sequence[int] = (10, 50), metric: str = "cosine",
                            digits: int = 6, means_bytes: int = HOLD_BYTES, row_block: int = SCORE_ROWS,
                            item_block: int = SCORE_ITEMS, pass_bytes: int = FILE_BYTES) -> DataFrame:
    """D20 with the built-in user vector (mean of the history items' vectors). The means are taken where the
    rows are: a task holds rows worth about ``means_bytes`` of user vectors and adds up the item vectors file by file
    (``pass_bytes`` each), then counts over the first file. Only rows still open move on, with their user vectors. The
    ranking is that of :func:`evaluate_next_item`."""
    unit, k = metric == "cosine", max(ks)
    files, dim = _store_items(item_vecs, item, ivec, pass_bytes)
    ranks = _open_rows(rows, files, item, dim, unit, row_key, history, target, k, digits, row_block, item_block, means_bytes)
    ranks = _spread(stable(ranks))       # few rows, as a rule, but each meets all other files
    ranks = stable(_rank(ranks, files[1:], item, dim, unit, row_key, target, k, digits, row_block, item_block, means_bytes))
    return with_metrics(rows.select(row_key).join(ranks, row_key, "left"), ks)


def summarize(per_row: DataFrame, ks: Sequence[int] = (10, 50), digits: int = 6) -> DataFrame:
    """Long-form (metric, value) means over all evaluation rows: one
    aggregation pass, then the single result row is unpivoted."""
    names = [m for k in ks for m in (f"recall_{k}", f"ndcg_{k}")]
    one = per_row.agg(*[F.avg(m).alias(m) for m in names])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m), digits).alias("value")) for m in names])
    return one.select(F.explode(pairs).alias("_p")).select("_p.metric", "_p.value")
