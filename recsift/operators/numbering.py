"""Exact, distributed numbering primitives.

``row_number().over(Window.orderBy(...))`` without a partition key moves every
row into one task, and ``Window.partitionBy(user)`` puts a hot user (which may
hold a third of all rows) into one task. Both primitives here avoid that:

* :func:`global_row_number` range-partitions by the order key (the sampler
  splits a hot key over many partitions), pins the partition-local positions by
  a reliable checkpoint, counts rows per partition (one number per partition
  reaches the driver) and adds the prefix offsets by a broadcast join with
  that partition-sized table.
* :func:`rank_within` ranks inside a key: ordinary keys by one window per
  key; keys above a row bound ("hot", a provably small set) are split off
  and ranked by the global number minus the key's first global number
  (a partial ``min`` aggregation; the join back is skew-split by AQE).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable

_LOCAL_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the in-partition index in the low 33 bits


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "rn",
                      start: int = 1) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in ``order`` (make it a total order)."""
    tagged = (df.orderBy(*_cols(order))
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = stable(tagged)
    counts = dict((r["_pid"], r["_n"]) for r in
                  tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, acc = [], 0
    for pid in sorted(counts):
        offsets.append((pid, acc))
        acc += counts[pid]
    # one offset per partition (bounded by the partition count, not the data)
    off = df.sparkSession.createDataFrame(offsets, "_off_pid int, _off long")
    return (tagged.join(F.broadcast(off), F.col("_pid") == F.col("_off_pid"))
                  .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOCAL_BITS)) + F.lit(start))
                  .drop("_pid", "_mid", "_off_pid", "_off"))


# A key with more rows than this is "hot": its rows are ranked by the
# distributed numbering instead of one window task.
HOT_KEY_ROWS = 2_000_000
# Hot keys are at most rows / HOT_KEY_ROWS; beyond this many the hot set is
# joined by shuffle instead of broadcast.
HOT_KEYS_BROADCAST = 200_000


def rank_by_numbering(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str,
                       size_col: str | None, few_keys: bool = False) -> DataFrame:
    """Rank inside ``keys`` by the global number less the key's first one: no key meets in one task."""
    g = global_row_number(df, [*keys, *order], "_g")
    aggs = [F.min("_g").alias("_g0")]
    if size_col:
        aggs.append(F.count(F.lit(1)).alias(size_col))
    first = g.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*aggs)  # one row per hot key: counted, bounded
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return g.join(F.broadcast(first) if few_keys else first, same).withColumn(name, F.col("_g") - F.col("_g0") + 1) \
        .drop("_g", "_g0", *[f"_k{i}" for i in range(len(keys))])


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rn",
                size_col: str | None = None, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """See :func:`rank_within_stats` (this drops the statistics)."""
    return rank_within_stats(df, keys, order, name, size_col, hot_rows)[0]


def rank_within_stats(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rn",
                      size_col: str | None = None, hot_rows: int = HOT_KEY_ROWS,
                      count_from: DataFrame | None = None) -> tuple[DataFrame, int]:
    """1-based position of each row inside its ``keys`` group in ``order``
    (make it a total order); optionally ``size_col`` = rows in the group.

    Rows per key are counted first, from ``count_from`` (a cheap table with the same keys and at
    least as many rows of each, such as the source before dedup; default ``df``): a scan of
    the key columns and a map-side combined aggregate, nothing is written. Keys up
    to ``hot_rows`` rows are ranked by one window per key; hot keys — at most
    rows / hot_rows of them, so the set is small and its size is known — are
    split off and ranked by the range-partitioned global numbering, which
    spreads a single key over many tasks. Exact for any skew. Also returns
    the largest group size (an upper bound with ``count_from``)."""
    order_c = _cols(order)
    names = [f"_h{i}" for i in range(len(keys))]
    sizes = (df if count_from is None else count_from).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]) \
        .agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > hot_rows).select(*names)
    st = sizes.agg(F.max("_n").alias("m"), F.sum((F.col("_n") > hot_rows).cast("long")).alias("h")).first()
    max_rows, n_hot = int(st["m"] or 0), int(st["h"] or 0)
    w = Window.partitionBy(*keys)

    def cold_ranks(x: DataFrame) -> DataFrame:
        x = x.withColumn(name, F.row_number().over(w.orderBy(*order_c)).cast("long"))
        return x.withColumn(size_col, F.count(F.lit(1)).over(w)) if size_col else x

    if n_hot == 0:
        return cold_ranks(df), max_rows
    small_hot = n_hot <= HOT_KEYS_BROADCAST
    hot_side = F.broadcast(hot) if small_hot else hot
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    ranked_cold = cold_ranks(df.join(hot_side, same, "left_anti"))
    ranked_hot = rank_by_numbering(df.join(hot_side, same, "left_semi"), keys, order_c, name, size_col, small_hot)
    return ranked_cold.unionByName(ranked_hot.select(*ranked_cold.columns)), max_rows


def dense_ids(tokens: DataFrame, token_col: str, order: Sequence[str | Column], id_col: str = "id",
              start: int = 1) -> DataFrame:
    """Contiguous ids ``start..`` for the distinct tokens of ``tokens`` in ``order``.

    ``tokens`` must already hold one row per token (e.g. the result of a
    first-appearance ``min`` aggregation)."""
    return global_row_number(tokens, order, id_col, start).select(token_col, id_col)
