"""Registered queries: sequential-recommendation preparation."""

from __future__ import annotations

from ..operators import sequences as sq
from ..operators.interactions import history_text
from ..operators.textprep import clean_item_text_rec
from ..operators.userlog import timestamp_split
from ..session import shared, stored
from ..sources import views
from .catalog import register
from .q_interactions import _thresholds
from .q_text import _REC_SQL
from .sqlviews import sql

MAX_LEN = 50

_SEQ = ("seq_rows", f"""
    SELECT user_id, parent_asin, "timestamp",
           CASE WHEN "timestamp" >= t_test THEN 'test' WHEN "timestamp" >= t_valid THEN 'valid' ELSE 'train' END AS split,
           CASE WHEN "timestamp" >= t_test THEN 2 WHEN "timestamp" >= t_valid THEN 1 ELSE 0 END AS so, h
    FROM (SELECT *, list(parent_asin) OVER (PARTITION BY user_id ORDER BY "timestamp", parent_asin
                                           ROWS BETWEEN {MAX_LEN} PRECEDING AND 1 PRECEDING) AS h
          FROM interactions WHERE parent_asin IN (SELECT parent_asin FROM items)), thresholds
    WHERE len(coalesce(h, [])) > 0""")
_USERS = ("user_map", """
    SELECT user_id, row_number() OVER (ORDER BY k, user_id) AS uid
    FROM (SELECT user_id, min({'s': so, 'u': user_id, 't': "timestamp"}) AS k FROM seq_rows GROUP BY 1)""")
_ITEMS = ("item_map", """
    SELECT tok AS parent_asin, row_number() OVER (ORDER BY k, tok) AS iid
    FROM (SELECT tok, min(k) AS k FROM (
            SELECT parent_asin AS tok, {'s': so, 'u': user_id, 't': "timestamp", 'p': 0} AS k FROM seq_rows
            UNION ALL
            SELECT tok, {'s': so, 'u': user_id, 't': "timestamp", 'p': p} FROM
              (SELECT so, user_id, "timestamp", unnest(h) AS tok, generate_subscripts(h, 1) AS p FROM seq_rows))
          GROUP BY 1)""")
_META = ("item_text", f"SELECT parent_asin, {_REC_SQL} AS cleaned_metadata FROM items")


def _q(body, *extra):
    return sql(body, "interactions", "items", "thresholds", extra=(_SEQ, *extra))


def _prepare(spark, sf):
    t_valid, t_test = _thresholds(spark, sf)
    return sq.prepare_from_log(views.user_log(spark, sf), views.items(spark, sf), t_valid, t_test, MAX_LEN)


def _seqs(spark, sf):
    """The prepared sequences (the .inter sink content); read by several
    later steps, so they are stored once an application."""
    return shared(spark, "sequences", views.source(sf, "lineitem", "orders", "part"), lambda: stored(_prepare(spark, sf)))


@register("prepare_sequences", "D4 P8 P9 P10 J1", _q(
    "SELECT user_id, parent_asin, \"timestamp\", split, array_to_string(h, ' ') AS history FROM seq_rows"))
def q_prepare_sequences(spark, sf):
    return _prepare(spark, sf).select("user_id", "parent_asin", "timestamp", "split",
                                   history_text("history").alias("history"))


@register("process_split_files", "P8 P9 P10 D4", _q(
    "SELECT user_id, parent_asin, \"timestamp\", split, array_to_string(h, ' ') AS history FROM seq_rows"))
def q_process_split_files(spark, sf):
    """From ready split rows with full histories (the K2 files) instead of raw interactions."""
    t_valid, t_test = _thresholds(spark, sf)
    rows = timestamp_split(views.user_log(spark, sf), t_valid, t_test, history=True)
    out = sq.process_histories(rows, views.items(spark, sf), MAX_LEN)
    return out.select("user_id", "parent_asin", "timestamp", "split", history_text("history").alias("history"))


@register("remap_users", "D5 U2", _q("SELECT * FROM user_map", _USERS))
def q_remap_users(spark, sf):
    return sq.remap_users(_seqs(spark, sf))


@register("remap_items", "D5 U2", _q("SELECT * FROM item_map", _ITEMS))
def q_remap_items(spark, sf):
    return sq.remap_items(_seqs(spark, sf))


@register("id_metadata", "D6 J10", _q(
    "SELECT m.parent_asin, m.iid, t.cleaned_metadata FROM item_map m JOIN item_text t ON m.parent_asin = t.parent_asin",
    _ITEMS, _META))
def q_id_metadata(spark, sf):
    return sq.id_metadata(sq.remap_items(_seqs(spark, sf)), clean_item_text_rec(views.items(spark, sf)))


_STATS = """
    SELECT 'n_users' AS metric, CAST(count(*) AS DOUBLE) AS value FROM user_map
    UNION ALL SELECT 'n_items', CAST(count(*) AS DOUBLE) FROM item_map
    UNION ALL SELECT 'n_interactions_' || split, CAST(count(*) + sum(CASE WHEN len(h) = 1 THEN 1 ELSE 0 END) AS DOUBLE)
              FROM seq_rows GROUP BY split
    UNION ALL SELECT 'n_interactions_total', CAST(count(*) + sum(CASE WHEN len(h) = 1 THEN 1 ELSE 0 END) AS DOUBLE)
              FROM seq_rows
    UNION ALL SELECT 'avg_history_length', round(sum(len(h)) / count(*), 6) FROM seq_rows
    UNION ALL SELECT 'avg_metadata_chars', round(avg(length(cleaned_metadata)), 6)
              FROM item_map m JOIN item_text t ON m.parent_asin = t.parent_asin"""


@register("dataset_stats", "A5", _q(_STATS, _USERS, _ITEMS, _META))
def q_dataset_stats(spark, sf):
    seqs = _seqs(spark, sf)
    users, items_map = sq.remap_ids(seqs)
    return sq.dataset_stats(seqs, users, items_map, clean_item_text_rec(views.items(spark, sf)))
