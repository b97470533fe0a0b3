"""Interaction-table operators: keep-earliest dedup, degree counts, k-core,
leave-last-out and absolute-time splits, split thresholds and histories.

Every function takes and returns DataFrames. Grouping by user is done either
by partial (map-side combined) aggregations or through the skew-safe ranks of
:mod:`.numbering`, never by a window partitioned by user alone, so a user that
holds a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable, stored
from .numbering import global_row_number, rank_within_stats

USER, ITEM, RATING, TS = "user_id", "parent_asin", "rating", "timestamp"

# Rows per (user, block) inside a history window; a longer user is cut into
# blocks, so no task ever sees more than one block (plus a halo of max_len rows).
HISTORY_BLOCK_ROWS = 4096


# --------------------------------------------------------------------- W1 / A1
def dedup_keep_earliest(ix: DataFrame, user: str = USER, item: str = ITEM, ts: str = TS,
                        tie: Sequence[str] = ("seq",)) -> DataFrame:
    """First interaction per (user, item) by time.

    ``min(struct(ts, tie..., rest...))`` is a partial aggregate, so a hot pair is
    combined map-side; ``tie`` replaces the reference's file order.
    """
    rest = [c for c in ix.columns if c not in (user, item, ts, *tie)]
    tie = [c for c in tie if c in ix.columns]
    first = F.min(F.struct(*[F.col(c) for c in (ts, *tie, *rest)])).alias("_x")
    out = ix.groupBy(user, item).agg(first)
    return out.select(user, item, *[F.col(f"_x.{c}").alias(c) for c in (ts, *tie, *rest)]).select(ix.columns)


def user_counts(ix: DataFrame, user: str = USER) -> DataFrame:
    return ix.groupBy(user).agg(F.count(F.lit(1)).alias("n_interactions"))


def item_counts(ix: DataFrame, item: str = ITEM) -> DataFrame:
    return ix.groupBy(item).agg(F.count(F.lit(1)).alias("n_interactions"))


def degree_threshold(counts: DataFrame, k: int, count_col: str = "n_interactions") -> tuple[DataFrame, DataFrame]:
    """A4: split a degree table into (kept, dropped) at threshold ``k``."""
    return counts.filter(F.col(count_col) >= k), counts.filter(F.col(count_col) < k)


# --------------------------------------------------------------------- A2 / A3
DROP_BROADCAST_ROWS = 500_000  # ids to drop in a round that are broadcast
REWRITE = 0.3                  # share of removed edges at which the rest is written anew


@dataclass
class KCoreResult:
    edges: DataFrame
    trace: list[tuple[int, int, int, int]]  # (round, interactions, users, items) after each removing round
    converged: bool = True                  # False: stopped by max_rounds, the edges are not a core yet

    def trace_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.trace, "round int, interactions long, users long, items long")


def k_core(ix: DataFrame, k_user: int, k_item: int | None = None, user: str = USER, item: str = ITEM,
           max_rounds: int | None = None) -> KCoreResult:
    """Iterated (k_user, k_item)-core of the user-item graph (A2, A3).

    Each round drops every user with fewer than ``k_user`` edges and every
    item with fewer than ``k_item`` edges *at the same time* (degrees from the
    previous round), until nothing falls below. A zero threshold disables that
    side. Edges are stored and counted once. A round then finds the edges of the ids it
    drops (a scan of the two key columns, broadcast joins while the counted drop sets are small),
    stores those only and subtracts their counts from the degrees of the ids at their other ends: what is shuffled and written after
    the first count is in proportion to the removed edges and the ids. Edges are rewritten when more than ``REWRITE`` of them are
    gone, so scans stay in proportion to what is left. Rows with a null user or item are no
    edges and are left out. Stopping at ``max_rounds`` is told by ``converged``.
    """
    k_item = k_user if k_item is None else k_item
    if not k_user and not k_item:
        return KCoreResult(ix, [])
    base = stored(ix.filter(F.col(user).isNotNull() & F.col(item).isNotNull()))
    sides = {user: k_user, item: k_item}
    degree = {c: stored(base.groupBy(c).agg(F.count(F.lit(1)).alias("_d"))) for c in sides}
    edges = n_base = base.count()
    gone: dict[str, list[tuple[DataFrame, int]]] = {c: [] for c in sides}   # ids dropped since the edges were written
    trace: list[tuple[int, int, int, int]] = []

    def without(x: DataFrame) -> DataFrame:
        for c in sides:
            for ids, n in gone[c]:
                x = x.join(F.broadcast(ids) if n <= DROP_BROADCAST_ROWS else ids, c, "left_anti")
        return x

    rnd = 0
    while True:
        counts = {c: degree[c].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("_d") < k).cast("long")), F.lit(0)).alias("low")).first()
                  for c, k in sides.items()}
        if rnd > 0:
            trace.append((rnd, edges, counts[user]["n"], counts[item]["n"]))
        if not any(r["low"] for r in counts.values()):
            break
        if max_rounds is not None and rnd >= max_rounds:
            return KCoreResult(without(base), trace, converged=False)
        drop = {c: degree[c].filter(F.col("_d") < k).select(c) for c, k in sides.items()}
        hit = without(base.select(user, item))
        for i, c in enumerate(sides):
            ids = drop[c].select(F.col(c).alias(f"_x{i}"))
            ids = F.broadcast(ids) if counts[c]["low"] <= DROP_BROADCAST_ROWS else ids
            hit = hit.join(ids, F.col(c) == F.col(f"_x{i}"), "left")
        removed = stored(hit.filter(F.col("_x0").isNotNull() | F.col("_x1").isNotNull()).select(user, item))
        n_removed = removed.count()
        for c, k in sides.items():
            less = removed.groupBy(c).agg(F.count(F.lit(1)).alias("_less"))
            left = degree[c].filter(F.col("_d") >= k).join(less, c, "left").select(c, (F.col("_d") - F.coalesce("_less", F.lit(0))).alias("_d"))
            degree[c] = stored(left.filter("_d > 0"))
            gone[c].append((drop[c], counts[c]["low"]))
        edges -= n_removed
        if edges < (1 - REWRITE) * n_base:
            base = stored(without(base))
            n_base, gone = edges, {c: [] for c in sides}
        rnd += 1
    return KCoreResult(without(base), trace)


# --------------------------------------------------------------------- W2 / W3
def chronological_rank(ix: DataFrame, user: str = USER, item: str = ITEM, ts: str = TS,
                       name: str = "rn", size_col: str | None = "n_user") -> DataFrame:
    """1-based position of each interaction in its user's time order
    (ties by item), plus the user's row count; skew-safe."""
    return chronological_rank_stats(ix, user, item, ts, name, size_col)[0]


def chronological_rank_stats(ix: DataFrame, user: str = USER, item: str = ITEM, ts: str = TS,
                             name: str = "rn", size_col: str | None = "n_user",
                             count_from: DataFrame | None = None) -> tuple[DataFrame, int]:
    """:func:`chronological_rank` plus the longest user's row count."""
    return rank_within_stats(ix, [user], [F.col(ts), F.col(item)], name, size_col, count_from=count_from)


def last_out_split(ranked: DataFrame, rank: str = "rn", size_col: str = "n_user") -> DataFrame:
    """Last row → test, second last → valid, the rest → train."""
    back = F.col(size_col) - F.col(rank)
    return ranked.withColumn("split", F.when(back == 0, "test").when(back == 1, "valid").otherwise("train"))


def timestamp_split_col(ts: str | Column, t_valid: int, t_test: int) -> Column:
    """D2 rule: ``ts ≥ t_test`` test; ``≥ t_valid`` valid; else train (stateless)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.when(c >= F.lit(t_test), "test").when(c >= F.lit(t_valid), "valid").otherwise("train")


# --------------------------------------------------------------------- W4 / W5
def with_history(ranked: DataFrame, user: str = USER, item: str = ITEM, rank: str = "rn",
                 max_len: int | None = None, size_col: str | None = "n_user", out: str = "history",
                 block_rows: int = HISTORY_BLOCK_ROWS, max_user_rows: int | None = None) -> DataFrame:
    """Items the user had before each row, oldest first (W4; W5 with ``max_len``).

    ``ranked`` carries the skew-safe rank inside the user. Users are cut into
    blocks of ``block_rows`` ranks; a window runs per (user, block):

    * bounded (``max_len=n``): each block also receives the last ``n`` rows of
      the block before it (a halo), so a frame ``rows -n..-1`` never leaves
      its block;
    * full: the in-block prefix comes from the window and the items of all
      earlier blocks from a prefix table, put together per (user, block), which
      exists only for users longer than one block.

    When ``max_user_rows`` (the longest user, known from the ranking pass)
    fits in one block, a single window per user is used: it needs the same
    partitioning as the ranking window, so no further shuffle happens.
    """
    if max_len is not None and max_len <= 0:
        return ranked.withColumn(out, F.array().cast(f"array<{dict(ranked.dtypes)[item]}>"))
    blk = max(block_rows, max_len or 0)
    if max_user_rows is not None and max_user_rows <= blk:
        lo = Window.unboundedPreceding if max_len is None else -max_len
        w1 = Window.partitionBy(user).orderBy(rank).rowsBetween(lo, -1)
        return ranked.withColumn(out, F.collect_list(item).over(w1))
    base = ranked.withColumn("_b", F.floor((F.col(rank) - 1) / blk).cast("long")).withColumn("_own", F.lit(True))
    rows = base
    if max_len is not None:
        halo = (base.filter(F.pmod(F.col(rank) - 1, F.lit(blk)) >= blk - max_len)
                .withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False)))
        rows = base.unionByName(halo)
        frame = (-max_len, -1)
    else:
        frame = (Window.unboundedPreceding, -1)
    w = Window.partitionBy(user, "_b").orderBy(rank).rowsBetween(*frame)
    rows = rows.withColumn(out, F.collect_list(item).over(w)).filter("_own").drop("_own")
    if max_len is None:
        from .userlog import block_prefixes

        long_users = ranked if size_col is None else ranked.filter(F.col(size_col) > blk)
        blocks = (long_users.withColumn("_block", F.floor((F.col(rank) - 1) / blk).cast("long"))
                  .groupBy(F.col(user).alias("_user"), "_block").agg(F.transform(F.array_sort(F.collect_list(
                      F.struct(F.col(rank).alias("r"), F.col(item).alias("i")))), lambda s: s["i"]).alias("_items")))
        prefix = block_prefixes(blocks).select(F.col("_user").alias("_pu"), F.col("_block").alias("_pb"),
                                               F.col("_before").alias("_prefix"))
        rows = (rows.join(prefix, rows[user].eqNullSafe(prefix["_pu"]) & (rows["_b"] == prefix["_pb"]), "left")
                .drop("_pu", "_pb").withColumn(out, F.when(F.col("_prefix").isNull(), F.col(out))
                            .otherwise(F.concat("_prefix", out))).drop("_prefix"))
    return rows.drop("_b")


def history_text(col: str | Column) -> Column:
    """K2 format: items joined by one space; empty history is ''."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat_ws(" ", F.transform(c, lambda x: x.cast("string")))


# --------------------------------------------------------------------- D2 / D3
def last_out(ix: DataFrame, history: bool = False, max_len: int | None = None, user: str = USER,
             item: str = ITEM, ts: str = TS) -> DataFrame:
    """D3: leave-last-out split of deduplicated interactions (+ history)."""
    ranked, longest = chronological_rank_stats(ix, user, item, ts)
    out = last_out_split(ranked)
    if history:
        out = with_history(out, user, item, max_len=max_len, max_user_rows=longest)
    return out.drop("rn", "n_user")


def timestamp_split(ix: DataFrame, t_valid: int, t_test: int, history: bool = False,
                    max_len: int | None = None, user: str = USER, item: str = ITEM, ts: str = TS) -> DataFrame:
    """Absolute-time split (+ history over all earlier rows, across splits)."""
    out = ix.withColumn("split", timestamp_split_col(ts, t_valid, t_test))
    if history:
        ranked, longest = chronological_rank_stats(out, user, item, ts)
        out = with_history(ranked, user, item, max_len=max_len, max_user_rows=longest).drop("rn", "n_user")
    return out


# --------------------------------------------------------------------------- A10
QUANTILE_BUCKETS = 1 << 16
SKETCH = 10_000    # accuracy of the sketch that brackets quantiles
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def exact_quantiles(df: DataFrame, col: str, fractions: Sequence[float]) -> list[tuple[float, object]]:
    """Exact discrete quantiles (SQL ``percentile_disc``: the value at 1-based
    position ceil(p·N) of the sorted non-null values).

    Integral columns: one pass takes count, extremes and a mergeable quantile sketch
    (``percentile_approx``), which brackets every wanted position within ``3 / SKETCH``
    of the rows. Each further pass counts the values of every open bracket in
    ``QUANTILE_BUCKETS`` equal buckets (a scan of the pruned source and a
    partial aggregate; at most buckets × quantiles rows reach the driver) and
    keeps the bucket that holds the wanted position, until it is one
    value; a bracket of up to ``QUANTILE_BUCKETS`` values ends in one pass. Nothing is written or sorted.
    Other types fall back to the distributed global numbering (a range sort)."""
    x = df.select(F.col(col).alias("_x")).filter(F.col("_x").isNotNull())
    if dict(df.dtypes)[col] not in _INTEGRAL:
        x = stable(x)
        n = x.count()
        want = {float(p): min(n, max(1, math.ceil(Fraction(repr(p)) * n))) for p in fractions}
        if n == 0:
            return [(p, None) for p in want]
        numbered = global_row_number(x, [F.col("_x")], "_pos")
        got = {r["_pos"]: r["_x"] for r in numbered.filter(F.col("_pos").isin(list(set(want.values())))).collect()}
        return [(p, got[want[p]]) for p in want]
    asked = [float(p) for p in fractions]
    ends = [min(1.0, max(0.0, p + d)) for p in asked for d in (-3 / SKETCH, 3 / SKETCH)]
    row = x.agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"),
                F.percentile_approx("_x", ends, SKETCH).alias("q")).first()
    n = int(row["n"])
    if n == 0:
        return [(p, None) for p in asked]
    want = {p: min(n, max(1, math.ceil(Fraction(repr(p)) * n))) for p in asked}
    state = {p: [int(row["q"][2 * i]), int(row["q"][2 * i + 1])] for i, p in enumerate(asked)}
    done: dict[float, int] = {}
    while len(done) < len(state):
        open_ = [p for p in state if p not in done]
        parts, widths = [], {}
        for t, p in enumerate(open_):
            lo, hi = state[p]
            widths[p] = w = -(-(hi - lo + 1) // QUANTILE_BUCKETS)
            # bucket -1 counts the rows below the bracket
            parts.append(F.when(F.col("_x") < F.lit(lo), F.struct(F.lit(t).alias("t"), F.lit(-1).cast("long").alias("b")))
                         .when(F.col("_x") <= F.lit(hi), F.struct(F.lit(t).alias("t"), F.expr(f"(_x - {lo}L) div {w}L").alias("b"))))
        counts = (x.select(F.explode(F.array(*parts)).alias("_s")).filter(F.col("_s").isNotNull())
                  .groupBy("_s.t", "_s.b").agg(F.count(F.lit(1)).alias("c")).collect())
        per: dict[int, list[tuple[int, int]]] = {}
        for r in counts:
            per.setdefault(r["t"], []).append((r["b"], r["c"]))
        for t, p in enumerate(open_):
            (lo, hi), w, below = state[p], widths[p], 0
            state[p] = [int(row["lo"]), int(row["hi"])]     # a bracket that misses starts over
            for b, c in sorted(per.get(t, [])):
                if below + c >= want[p]:
                    if b >= 0:
                        state[p] = [lo + b * w, min(hi, lo + (b + 1) * w - 1)]
                        if w == 1:
                            done[p] = lo + b
                    break
                below += c
    return [(p, done[p]) for p in asked]


def split_thresholds(df: DataFrame, fractions: Sequence[float] = (0.8, 0.9), ts: str = TS) -> DataFrame:
    """A10: the timestamps at the given cumulative shares (exact, see
    :func:`exact_quantiles`), as a small (fraction, threshold) table."""
    rows = exact_quantiles(df, ts, fractions)
    typ = dict(df.dtypes)[ts]
    return df.sparkSession.createDataFrame(rows, f"fraction double, threshold {typ}")


# --------------------------------------------------------------------------- D1
def build_rating_only(raw: DataFrame, k: int, user: str = USER, item: str = ITEM, ts: str = TS,
                      tie: Sequence[str] = ("seq",)) -> tuple[DataFrame, KCoreResult]:
    """Keep-earliest dedup (the 0-core file) and its (k, k)-core."""
    zero = dedup_keep_earliest(raw, user, item, ts, tie)
    return zero, k_core(zero, k, k, user, item)


# ------------------------------------------------------------- one run per category
def per_category(ix: DataFrame, category: str, run, user: str = USER, item: str = ITEM) -> DataFrame:
    """``run(rows, user, item)`` as if once for every category: users and items are keyed by
    (category, id), so degrees, ranks and histories never mix categories, in one Spark plan."""
    keyed = ix.withColumns({"_cu": F.struct(category, user), "_ci": F.struct(category, item)})
    return run(keyed, "_cu", "_ci").drop("_cu", "_ci")
