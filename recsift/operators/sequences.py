"""Sequential-recommendation preparation.

Rewrite R1: filtering unknown history items, dropping empty histories and
keeping the last ``n`` equals — on the full histories of the time split —
"semi-join the interactions with known items first, then take a bounded
history over what is left". That replaces quadratic full histories by
``rows × n`` work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .interactions import ITEM, TS, USER, chronological_rank_stats, timestamp_split_col, with_history
from ..session import stable
from .numbering import dense_ids
from .userlog import UserLog

KNOWN_BROADCAST = 4_000_000   # ids of known items that are shipped to the rows
SPLIT_ORDER = {"train": 0, "valid": 1, "test": 2}


def history_known_items(ix: DataFrame, items: DataFrame, item: str = ITEM) -> DataFrame:
    """Keep interactions whose item has metadata (left semi join; the rows stay where they are while
    the counted ids can be broadcast)."""
    known = items.select(item)
    return ix.join(F.broadcast(known) if known.count() <= KNOWN_BROADCAST else known, item, "left_semi")


def prepare_sequences(ix: DataFrame, items: DataFrame, t_valid: int, t_test: int, max_len: int = 50,
                      user: str = USER, item: str = ITEM, ts: str = TS) -> DataFrame:
    """(user, history of ≤ max_len known items, target, split), rows with
    an unknown target or an empty history dropped (P8, P9, P10 via R1)."""
    known = history_known_items(ix, items, item)
    ranked, longest = chronological_rank_stats(known, user, item, ts)
    out = with_history(ranked, user, item, max_len=max_len, max_user_rows=longest)
    out = out.filter(F.size("history") > 0).drop("rn", "n_user")
    return out.withColumn("split", timestamp_split_col(ts, t_valid, t_test))


def prepare_from_log(log: UserLog, items: DataFrame, t_valid: int, t_test: int, max_len: int = 50) -> DataFrame:
    """:func:`prepare_sequences` over a stored log: the rows of known items keep their place and
    order, so the bounded window needs no rank of its own. Crowded users' known rows are ranked anew."""
    w = Window.partitionBy(log.user).orderBy("rn").rowsBetween(-max_len, -1)
    out = history_known_items(log.ordinary, items, log.item).withColumn("history", F.collect_list(log.item).over(w))
    out = out.filter(F.size("history") > 0).drop("rn", "n_user").select(*log.columns, "history")
    out = out.withColumn("split", timestamp_split_col(log.ts, t_valid, t_test))
    if log.crowded is None:
        return out
    more = prepare_sequences(log.crowded.select(*log.columns), items, t_valid, t_test, max_len, log.user, log.item, log.ts)
    return out.unionByName(more.select(*out.columns))


def process_histories(rows: DataFrame, items: DataFrame, max_len: int = 50, history: str = "history",
                      item: str = ITEM, known_broadcast: int = KNOWN_BROADCAST) -> DataFrame:
    """P8-P10 on ready split rows with a ``history`` array: items without metadata leave the
    histories, the last ``max_len`` stay, and rows with an unknown target or an empty
    history are dropped. While the counted ids can be shipped, every row is filtered in its place, an
    Arrow batch's histories at once; beyond that histories are exploded with their row's number and
    position, joined with the items and gathered again, so no item list travels whole."""
    known = items.select(F.col(item).alias("_known")).filter(F.col("_known").isNotNull()).distinct()
    if known.count() > known_broadcast:
        return _process_exploded(rows, known, max_len, history, item)
    bc = rows.sparkSession.sparkContext.broadcast(known.toPandas()["_known"].to_numpy())  # counted above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pd.Index(bc.value)
        for batch in batches:
            at = batch.schema.get_field_index(history)
            col = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = col.flatten()                  # of the lists that are not null
            hit = _is_known(index, values)
            upto = np.r_[0, np.cumsum(hit)]
            end = upto[np.cumsum(sizes)]
            start = np.maximum(upto[np.cumsum(sizes) - sizes], end - max_len)
            kept = values.filter(pa.array(hit))
            row = np.flatnonzero((end > start) & _is_known(index, batch.column(batch.schema.get_field_index(item))))
            n = (end - start)[row]
            offsets = np.r_[0, np.cumsum(n)]
            take = np.repeat(start[row] - offsets[:-1], n) + np.arange(offsets[-1])
            new = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), kept.take(pa.array(take)))
            out = [new if i == at else batch.column(i).take(pa.array(row)) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _is_known(index: pd.Index, values: pa.Array) -> np.ndarray:
    """Which values are in ``index`` (nulls are not)."""
    if values.null_count:
        valid = values.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(values), dtype=bool)
        out[valid] = _is_known(index, values.drop_null())
        return out
    return index.get_indexer(values.to_numpy(zero_copy_only=False)) >= 0


def _process_exploded(rows: DataFrame, known: DataFrame, max_len: int, history: str, item: str) -> DataFrame:
    """:func:`process_histories` by joins, for more items than can be shipped."""
    x = stable(rows.withColumn("_row", F.monotonically_increasing_id()))
    kept = x.select("_row", F.posexplode(history).alias("_pos", "_tok")).join(known, F.col("_tok") == F.col("_known"), "left_semi")
    gathered = kept.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_tok"))).alias("_h"))
    gathered = gathered.select(F.col("_row").alias("_r"), F.slice(F.transform("_h", lambda s: s["_tok"]), F.greatest(
        F.size("_h") - max_len + 1, F.lit(1)), F.lit(max_len)).alias("_new"))
    out = x.join(known, F.col(item) == F.col("_known"), "left_semi").join(gathered, F.col("_row") == F.col("_r"))
    return out.withColumn(history, F.col("_new")).drop("_row", "_r", "_new")


def _split_ord(col: str = "split"):
    c = F.col(col)
    return F.when(c == "train", 0).when(c == "valid", 1).otherwise(2)


def _first_keys(seqs: DataFrame, user: str, ts: str, tokens: F.Column | None = None) -> DataFrame:
    """Per element ``_tok`` of the rows' arrays ``tokens`` (none: per user) the smallest key (split, user,
    time, position) as ``_k``.

    Rows are first combined by (token, user): split, time and position in one long, a hash
    aggregate that keeps one row a pair however often windows repeat a token. Only those
    are compared as structs. Times that do not fit the long (or are no integers) are compared as structs at once."""
    size = F.lit(1) if tokens is None else F.size(tokens)
    rows = seqs.select(user, ts, _split_ord().alias("_s"), *([] if tokens is None else [F.posexplode(tokens).alias("_p", "_tok")]))
    pos, out = (F.lit(0), user) if tokens is None else (F.col("_p"), "_tok")
    lo, width = None, 0
    if dict(seqs.dtypes)[ts] in ("tinyint", "smallint", "int", "bigint"):
        lo, hi, most = seqs.agg(F.min(ts), F.max(ts), F.max(size)).first()
    if lo is not None:
        places, times = int(most) + 1, int(hi) - int(lo) + 2
        width = places * times if 3 * places * times < 1 << 62 else 0
    if not width:
        k = F.struct(F.col("_s").alias("s"), F.col(user).alias("u"), F.col(ts).alias("t"), pos.alias("p"))
        return rows.groupBy(out).agg(F.min(k).alias("_k"))
    at = F.coalesce(F.col(ts).cast("bigint") - F.lit(int(lo)) + 1, F.lit(0))     # a null time comes first
    code = F.col("_s") * F.lit(width) + at * F.lit(places) + pos
    firsts = rows.groupBy(*dict.fromkeys([out, user])).agg(F.min(code.cast("bigint")).alias("_c"))
    split = F.expr(f"_c div {width}L")
    k = F.struct(split.alias("s"), F.col(user).alias("u"), F.pmod("_c", F.lit(width)).alias("r"))
    return firsts.select(user, k.alias("_k")) if tokens is None else firsts.groupBy(out).agg(F.min(k).alias("_k"))


def remap_users(seqs: DataFrame, user: str = USER, ts: str = TS) -> DataFrame:
    """User ids from 1 by first appearance over the concatenated splits
    (train, valid, test; rows by user then time). First appearances are
    partial minima; numbering is the distributed global row number."""
    return dense_ids(_first_keys(seqs, user, ts), user, [F.col("_k"), F.col(user)], "uid")


def remap_items(seqs: DataFrame, user: str = USER, item: str = ITEM, ts: str = TS) -> DataFrame:
    """Item ids from 1 by first appearance; inside a row the target comes
    before its history, oldest first."""
    tokens = F.concat(F.array(item), F.coalesce("history", F.array().cast(seqs.schema["history"].dataType)))
    return dense_ids(_first_keys(seqs, user, ts, tokens), "_tok", [F.col("_k"), F.col("_tok")], "iid").withColumnRenamed("_tok", item)


def remap_ids(seqs: DataFrame, user: str = USER, item: str = ITEM, ts: str = TS) -> tuple[DataFrame, DataFrame]:
    """(user map, item map); see :func:`remap_users`, :func:`remap_items`."""
    return remap_users(seqs, user, ts), remap_items(seqs, user, item, ts)


def id_metadata(item_map: DataFrame, item_text: DataFrame, item: str = ITEM,
                text: str = "cleaned_metadata") -> DataFrame:
    """Id → cleaned metadata (items without text are left out)."""
    return item_map.join(item_text.select(item, text), item)


def dataset_stats(seqs: DataFrame, user_map: DataFrame, item_map: DataFrame, item_text: DataFrame,
                  item: str = ITEM, text: str = "cleaned_metadata") -> DataFrame:
    """A5: users, items, interactions per split and in total (a row whose
    history has exactly one item counts twice, as in the reference), mean
    history length, mean metadata characters. Long form (metric, value).

    ``seqs`` is read once (one grouped aggregate over three split rows)."""
    per_split = seqs.groupBy("split").agg(
        (F.count(F.lit(1)) + F.sum(F.when(F.size("history") == 1, 1).otherwise(0))).alias("n"),
        F.sum(F.size("history")).alias("h"), F.count(F.lit(1)).alias("rows"))
    counted = {r["split"]: r for r in per_split.collect()}  # at most three rows
    n_total = sum(int(r["n"]) for r in counted.values())
    h_total = sum(int(r["h"]) for r in counted.values())
    rows_total = sum(int(r["rows"]) for r in counted.values())
    meta = id_metadata(item_map, item_text, item, text).agg(F.avg(F.length(text)).alias("m")).first()["m"]
    metrics = [("n_users", float(user_map.count())), ("n_items", float(item_map.count()))]
    metrics += [(f"n_interactions_{sp}", float(counted[sp]["n"])) for sp in sorted(counted)]
    metrics += [("n_interactions_total", float(n_total)),
                ("avg_history_length", h_total / rows_total if rows_total else None),
                ("avg_metadata_chars", float(meta) if meta is not None else None)]
    out = seqs.sparkSession.createDataFrame(metrics, "metric string, value double")
    return out.select("metric", F.round("value", 6).alias("value"))
