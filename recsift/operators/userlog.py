"""A stored interaction log that dedup, rank, splits and histories share.

Raw rows are dealt by user once: in that one exchange they are deduplicated, ranked in time
order and written as a table bucketed by user and sorted by (user, rank). Whatever works per
user on the stored log (histories, bounded histories, sequences) finds its rows in place and
needs no further exchange of rows.

Users with more than ``PART_ROWS`` raw rows (counted from the source's user column, a map-side
combined aggregate; at most rows / PART_ROWS of them) are crowded. Their rows are deduplicated by (user, item),
numbered by the distributed numbering and stored by (user, part of ``PART_ROWS`` ranks), so no
task holds a whole crowded user.

*Full histories (W4).* A history is a prefix of its user's list. The list is stored once, as
blocks (user, block, items); a row only refers to it: (block, length), meaning all earlier blocks
and the first ``length`` items of its own (:func:`history_refs`). :func:`expand_history` builds the
lists themselves at the sink, per (user, block), never per user.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import workdir
from .numbering import HOT_KEYS_BROADCAST, rank_by_numbering

PART_ROWS = 2_000_000        # raw rows of a user in one task
BUCKET_ROWS = 2_000_000      # raw rows a bucket is meant for
HISTORY_BLOCK = 4096         # items of a stored history block


@dataclass
class UserLog:
    """``ordinary``: one row per (user, item) with ``rn`` and ``n_user``, bucketed by user.
    ``crowded``: the same for crowded users, with ``_part``; None when there are none."""
    ordinary: DataFrame
    crowded: DataFrame | None
    user: str
    item: str
    ts: str
    columns: list[str]
    part_rows: int
    longest: int          # most rows of an ordinary user (an upper bound)

    def rows(self) -> DataFrame:
        """All rows with ``rn`` and ``n_user``."""
        return self._both(lambda x, keys: x)

    def _both(self, run: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
        out = run(self.ordinary, [self.user])
        if self.crowded is None:
            return out
        more = run(self.crowded, [self.user, "_part"])
        return out.unionByName(more.drop("_part") if "_part" in more.columns else more)


def _store_bucketed(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    name = f"user_log_{uuid.uuid4().hex}"
    (df.write.format("parquet").bucketBy(n, *keys).sortBy(*order)
       .option("path", workdir(spark, name)).saveAsTable(name))
    return spark.table(name)


def build_user_log(raw: DataFrame, user: str = "user_id", item: str = "parent_asin", ts: str = "timestamp",
                   tie: Sequence[str] = ("seq",), part_rows: int = PART_ROWS, bucket_rows: int = BUCKET_ROWS) -> UserLog:
    """Dedup (W1), rank (W2) and store ``raw`` in one exchange of its rows."""
    from .interactions import dedup_keep_earliest

    spark = raw.sparkSession
    sizes = raw.groupBy(F.col(user).alias("_hu")).agg(F.count(F.lit(1)).alias("_n"))
    crowd = F.col("_n") > part_rows
    st = sizes.agg(F.sum("_n").alias("rows"), F.max(F.when(~crowd, F.col("_n"))).alias("longest"),
                   F.sum(crowd.cast("long")).alias("crowded")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(st["rows"] or 0) / bucket_rows))
    n_crowded = int(st["crowded"] or 0)
    hot = sizes.filter(crowd).select("_hu")
    hot = F.broadcast(hot) if n_crowded <= HOT_KEYS_BROADCAST else hot
    same = F.col(user).eqNullSafe(F.col("_hu"))
    few = raw if not n_crowded else raw.join(hot, same, "left_anti")
    own = Window.partitionBy(user)
    ranked = dedup_keep_earliest(few.repartition(n, user), user, item, ts, tie) \
        .withColumn("rn", F.row_number().over(own.orderBy(ts, item)).cast("long")) \
        .withColumn("n_user", F.count(F.lit(1)).over(own))
    ordinary = _store_bucketed(ranked, n, [user], [user, "rn"])
    crowded = None
    if n_crowded:
        many = dedup_keep_earliest(raw.join(hot, same, "left_semi"), user, item, ts, tie)
        many = rank_by_numbering(many, [user], [F.col(ts), F.col(item)], "rn", "n_user", n_crowded <= HOT_KEYS_BROADCAST)
        many = many.withColumn("_part", F.floor((F.col("rn") - 1) / part_rows).cast("long"))
        crowded = _store_bucketed(many.repartition(n, user, "_part"), n, [user, "_part"], [user, "_part", "rn"])
    return UserLog(ordinary, crowded, user, item, ts, raw.columns, part_rows, int(st["longest"] or 0))


# ---- histories ---------------------------------------------------------------------

def bounded_history(log: UserLog, max_len: int, out: str = "history") -> DataFrame:
    """The last ``max_len`` items before each row. Parts of a crowded user also get the last
    rows of the part before (a halo)."""
    def run(x: DataFrame, keys: list[str]) -> DataFrame:
        if max_len <= 0:
            return x.withColumn(out, F.array().cast(f"array<{x.schema[log.item].dataType.simpleString()}>"))
        if "_part" in keys:
            if max_len > log.part_rows:
                raise ValueError("a bounded history is longer than a part")
            halo = x.filter(F.pmod(F.col("rn") - 1, F.lit(log.part_rows)) >= log.part_rows - max_len) \
                .withColumn("_part", F.col("_part") + 1).withColumn("_own", F.lit(False))
            x = x.withColumn("_own", F.lit(True)).unionByName(halo)
        w = Window.partitionBy(*keys).orderBy("rn").rowsBetween(-max_len, -1)
        y = x.withColumn(out, F.collect_list(log.item).over(w))
        return y.filter("_own").drop("_own") if "_part" in keys else y
    return log._both(run)


def history_refs(log: UserLog, block: int = HISTORY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """W4 in its stored form: rows with ``_block`` and ``_len``, and the blocks (``_user, _block,
    _items``) they refer to. A row's history is every item of the earlier blocks and the first
    ``_len`` items of its own block; nothing is repeated per row."""
    at = F.floor((F.col("rn") - 1) / block).cast("long")
    rows = log.rows().withColumn("_block", at).withColumn("_len", F.col("rn") - 1 - F.col("_block") * block)
    blocks = rows.groupBy(F.col(log.user).alias("_user"), F.col("_block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", log.item))), lambda s: s[log.item]).alias("_items"))
    return rows, blocks


def block_prefixes(blocks: DataFrame) -> DataFrame:
    """``_user, _block, _before``: the items of all earlier blocks, for every block but the first.
    A block goes to each later one and they are put together per (user, block)."""
    last = blocks.groupBy(F.col("_user").alias("_lu")).agg(F.max("_block").alias("_last")).filter("_last > 0")
    sent = blocks.join(last, F.col("_user").eqNullSafe(F.col("_lu"))).filter("_block < _last").select(
        "_user", F.col("_block").alias("_from"), "_items", F.explode(F.expr("sequence(_block + 1, _last)")).alias("_block"))
    return sent.groupBy("_user", "_block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(
        F.struct("_from", "_items"))), lambda s: s["_items"])).alias("_before"))


def expand_history(rows: DataFrame, blocks: DataFrame, user: str = "user_id", out: str = "history") -> DataFrame:
    """The lists themselves, for a sink: rows meet their own block and its prefix by (user, block)."""
    whole = blocks.join(block_prefixes(blocks).select(F.col("_user").alias("_pu"), F.col("_block").alias("_pb"), "_before"),
                        F.col("_user").eqNullSafe(F.col("_pu")) & (F.col("_block") == F.col("_pb")), "left") \
        .select("_user", F.col("_block").alias("_ub"), "_items", "_before")
    x = rows.join(whole, F.col(user).eqNullSafe(F.col("_user")) & (F.col("_block") == F.col("_ub")))
    own = F.expr("slice(_items, 1, int(_len))")
    return x.withColumn(out, F.when(F.col("_before").isNull(), own).otherwise(F.concat("_before", own))) \
        .drop("_user", "_ub", "_items", "_before", "_block", "_len")


def full_history(log: UserLog, block: int = HISTORY_BLOCK, out: str = "history") -> DataFrame:
    """The items before each row. While no user exceeds one block a growing window over the
    stored layout gives the lists in place; beyond that they are expanded from shared blocks."""
    if log.crowded is None and log.longest <= block:
        w = Window.partitionBy(log.user).orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
        return log.ordinary.withColumn(out, F.collect_list(log.item).over(w))
    return expand_history(*history_refs(log, block), log.user, out)


# ---- splits ------------------------------------------------------------------------

def last_out(log: UserLog, history: bool = False, max_len: int | None = None) -> DataFrame:
    """D3: leave-last-out split of the log (+ history)."""
    from .interactions import last_out_split

    x = log.rows() if not history else full_history(log) if max_len is None else bounded_history(log, max_len)
    return last_out_split(x).drop("rn", "n_user")


def timestamp_split(log: UserLog, t_valid: int, t_test: int, history: bool = False, max_len: int | None = None) -> DataFrame:
    """Absolute-time split of the log (+ history over all earlier rows, across splits)."""
    from .interactions import timestamp_split_col

    x = log.rows() if not history else full_history(log) if max_len is None else bounded_history(log, max_len)
    return x.withColumn("split", timestamp_split_col(log.ts, t_valid, t_test)).drop("rn", "n_user")
