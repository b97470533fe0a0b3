"""Registered queries: text cleaning (D7-D9), filters and samples (P2-P12),
training rows (D10, D21, D22, F19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.hashing import sql_hash32, sql_hash_hex
from ..functions.text import clean_rec_text, clean_search_text
from ..operators import pairs as pr
from ..operators import sampling as sm
from ..operators import textprep as tp
from ..session import workdir
from ..sources import readers, views, writers
from . import sqltext as st
from .catalog import register
from .q_interactions import _thresholds
from .sqlviews import sql

SEED = 42


def _rec_list(c):
    inner = f"array_to_string(list_transform({c}, lambda v: {st.clean_rec('v', False)}), ', ')"
    return f"(CASE WHEN len({c}) > 0 THEN {inner} || '.' ELSE '' END)"


_TITLE = "coalesce(title, '')"
_REC_SQL = (f"{st.clean_rec(_TITLE, False)} || ' ' || {_rec_list('features')} || ' ' || "
            f"{_rec_list('categories')} || ' ' || {_rec_list('description')} || ' '")


@register("clean_item_rec", "D7 F4 F5 F6 F8", sql(
    f"SELECT parent_asin, {_REC_SQL} AS cleaned_metadata FROM items", "items"))
def q_clean_item_rec(spark, sf):
    return tp.clean_item_text_rec(views.items(spark, sf))


_DESC_JOINED = "array_to_string(description, ' ')"
_SEARCH_SQL = (f"replace(coalesce(CASE WHEN title IS NOT NULL THEN {st.clean_search('title', False)} || ' ' END, '') || "
               f"coalesce(CASE WHEN description IS NOT NULL THEN "
               f"{st.clean_search(_DESC_JOINED, False)} || ' ' END, ''), "
               f"chr(9), ' ')")


@register("clean_item_search", "D8 F7 F8", sql(
    f"SELECT parent_asin, {_SEARCH_SQL} AS cleaned_metadata FROM items", "items"))
def q_clean_item_search(spark, sf):
    return tp.clean_item_text_search(views.items(spark, sf))


_PRE_SQL = st.flat("concat_ws(' ', title, CASE WHEN len(features) > 0 THEN array_to_string(features, ' ') END, "
                   "CASE WHEN len(description) > 0 THEN array_to_string(description, ' ') END)")


@register("clean_item_pretrain", "D9 F3 F17", sql(
    f"SELECT parent_asin, {_PRE_SQL} AS cleaned_metadata FROM items", "items"))
def q_clean_item_pretrain(spark, sf):
    return tp.clean_item_text_pretrain(views.items(spark, sf))


@register("clean_review_pretrain", "D9 F3 F17", sql(
    f"SELECT user_id, parent_asin, {st.flat('concat_ws(' + st.lit(' ') + ', title, text)')} AS cleaned_review "
    "FROM reviews", "reviews"))
def q_clean_review_pretrain(spark, sf):
    reviews = views.reviews(spark, sf, ["user_id", "parent_asin"])
    return tp.clean_review_text(reviews).select("user_id", "parent_asin", "cleaned_review")


@register("clean_pages_rec", "F4 F5 F6", f"SELECT page_id, {st.clean_rec('html')} AS text FROM pages")
def q_clean_pages_rec(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", clean_rec_text("html").alias("text"))


@register("clean_pages_search", "F4 F7", f"SELECT page_id, {st.clean_search('html')} AS text FROM pages")
def q_clean_pages_search(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", clean_search_text("html").alias("text"))


@register("satisfied_reviews", "P2", sql(
    "SELECT user_id, parent_asin, rating, \"timestamp\", length(text) AS n_chars FROM reviews "
    "WHERE rating >= 5 AND length(text) >= 100", "reviews"))
def q_satisfied(spark, sf):
    return sm.satisfied_reviews(views.reviews(spark, sf)).select(
        "user_id", "parent_asin", "rating", "timestamp", F.length("text").cast("bigint").alias("n_chars"))


@register("hash_sample", "P6", sql(
    f"SELECT user_id, parent_asin, \"timestamp\" FROM interactions "
    f"WHERE {sql_hash32(['user_id', 'parent_asin'], SEED)} % 10 = 0", "interactions"))
def q_hash_sample(spark, sf):
    return sm.hash_sample(views.interactions(spark, sf), ["user_id", "parent_asin"], 10, SEED).select(
        "user_id", "parent_asin", "timestamp")


@register("sample_n", "P7", sql(
    "SELECT user_id, parent_asin FROM reviews WHERE rating >= 5 AND length(text) >= 100 "
    f"ORDER BY {sql_hash_hex(['user_id', 'parent_asin'], SEED)}, user_id, parent_asin LIMIT 1000", "reviews"))
def q_sample_n(spark, sf):
    sat = sm.satisfied_reviews(views.reviews(spark, sf)).select("user_id", "parent_asin")
    return sm.sample_n(sat, ["user_id", "parent_asin"], 1000, SEED)


@register("head_percent_split", "P12", sql(
    "SELECT conv_id, turn, CASE WHEN pos <= floor(0.01 * n + 0.5) THEN 'validation' ELSE 'train' END AS split "
    "FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS pos, count(*) OVER () AS n FROM pairs)",
    "pairs"))
def q_head_percent(spark, sf):
    p = views.pairs(spark, sf).select("conv_id", "turn")
    return sm.head_percent_split(p, ["conv_id", "turn"], 1.0)


@register("pretrain_pairs", "D10 P4 P5 P6 J1", sql(
    f"""SELECT r.user_id, r.parent_asin, r.review, m.meta
    FROM (SELECT user_id, parent_asin, {st.flat('concat_ws(' + st.lit(' ') + ', title, text)')} AS review
          FROM reviews, thresholds
          WHERE "timestamp" < t_valid AND {sql_hash32(['user_id', 'parent_asin'], SEED)} % 10 = 0) r
    JOIN (SELECT parent_asin, {_PRE_SQL} AS meta FROM items) m ON r.parent_asin = m.parent_asin
    WHERE length(r.review) > 30 AND length(m.meta) > 30""", "reviews", "items", "thresholds"))
def q_pretrain_pairs(spark, sf):
    return pr.build_pretrain_pairs(views.reviews(spark, sf), views.items(spark, sf), _thresholds(spark, sf)[0], 10, SEED)


_FILES = [f"Shop Part {i}" for i in range(4)]
# every fifth item stands in its own category file and, with another title, in the next one
_TWICE = """
    SELECT parent_asin, title, features, description, parent_asin % 4 AS category_no FROM items
    UNION ALL SELECT parent_asin, title || ' (as listed again)', features, description, (parent_asin + 1) % 4 FROM items
    WHERE parent_asin % 5 = 0"""


@register("pretrain_pairs_by_category", "D10 J2 U1 S3 F16", sql(
    f"""SELECT r.user_id, r.parent_asin, r.review, m.meta
    FROM (SELECT user_id, parent_asin, {st.flat('concat_ws(' + st.lit(' ') + ', title, text)')} AS review
          FROM reviews, thresholds
          WHERE "timestamp" < t_valid AND {sql_hash32(['user_id', 'parent_asin'], SEED)} % 10 = 0) r
    JOIN (SELECT parent_asin, {_PRE_SQL} AS meta FROM
          (SELECT * FROM ({_TWICE}) QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY category_no DESC) = 1)) m
      ON r.parent_asin = m.parent_asin
    WHERE length(r.review) > 30 AND length(m.meta) > 30""", "reviews", "items", "thresholds"))
def q_pairs_by_category(spark, sf):
    """Metadata read from one file per category; an item met in two takes the later file's row."""
    x = views.items(spark, sf).select("parent_asin", "title", "features", "description", (F.col("parent_asin") % 4).alias("c"))
    again = x.filter(F.col("parent_asin") % 5 == 0).withColumns({
        "title": F.concat("title", F.lit(" (as listed again)")), "c": (F.col("parent_asin") + 1) % 4})
    named = x.unionByName(again).withColumn("category", F.concat(F.lit("Shop Part "), F.col("c"))).drop("c")
    folder = writers.write_categories(named, workdir(spark, "categories"), _FILES)
    schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in ("parent_asin", "title", "features", "description"))
    items = readers.read_categories(spark, folder, _FILES, schema).drop("category")
    return pr.build_pretrain_pairs(views.reviews(spark, sf), items, _thresholds(spark, sf)[0], 10, SEED, item_order="category_no")


@register("clean_item_fields", "D7 D8 F9 F18", (
    f"SELECT p_partkey AS parent_asin, {st.clean_rec('p_name', False)} || ' ' || CAST(p_size AS VARCHAR) || '. ' AS rec, "
    "'{size:' || CAST(p_size AS VARCHAR) || ',brand:' || p_brand || '}. ' AS search FROM part"))
def q_item_fields(spark, sf):
    """A number field (text with a dot) and a record field (its JSON text)."""
    p = views.table(spark, sf, "part").select(F.col("p_partkey").alias("parent_asin"), F.col("p_name").alias("title"),
                                              F.col("p_size").alias("size"), F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("details"))
    rec = tp.clean_item_text_rec(p, lists=("size",), out="rec")
    return rec.join(tp.clean_item_text_search(p, fields=("details",), out="search"), "parent_asin")


@register("training_rows", "D21 P11", sql(
    "SELECT conv_id, turn, coalesce(sent0, ' ') AS sent0, coalesce(sent1, ' ') AS sent1 FROM pairs", "pairs"))
def q_training_rows(spark, sf):
    return pr.make_training_rows(views.pairs(spark, sf), ["sent0", "sent1"], keep=["conv_id", "turn"])


_KEY_SQL = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"


def _mask_sql():
    def h(seed):
        return st.hash32(f"{_KEY_SQL} || '|' || CAST(i - 1 AS VARCHAR) || '|{seed}'")
    chosen = f"(x NOT IN ({tk.PAD_ID}, {tk.CLS_ID}, {tk.SEP_ID}) AND {h(SEED)} % 10000 < 1500)"
    new = (f"CASE WHEN NOT {chosen} THEN x WHEN {h(SEED + 1)} % 10 < 8 THEN CAST({tk.MASK_ID} AS BIGINT) "
           f"WHEN {h(SEED + 1)} % 10 = 8 THEN {h(SEED + 2)} % {tk.VOCAB_SIZE} ELSE x END")
    label = f"CASE WHEN {chosen} THEN x ELSE CAST(-100 AS BIGINT) END"
    both = " UNION ALL ".join(f"SELECT conv_id, turn, CAST({n} AS INTEGER) AS sentence, {st.text_to_ids(f'sent{n}')} AS ids FROM pairs"
                              for n in (0, 1))
    return (f"SELECT conv_id, turn, sentence, {st.ids_text('ids')} AS input_ids, "
            f"{st.ids_text(f'list_transform(ids, lambda x, i: {new})')} AS mlm_input_ids, "
            f"{st.ids_text(f'list_transform(ids, lambda x, i: {label})')} AS mlm_labels "
            f"FROM ({both})")


@register("mask_tokens", "D22 F15", sql(_mask_sql(), "pairs"))
def q_mask_tokens(spark, sf):
    p = _sentences(spark, sf).select("conv_id", "turn", "sentence", F.concat_ws(":", "conv_id", "turn").alias("_k"),
                                     tk.text_to_ids("text").alias("input_ids"))
    m = pr.mask_tokens(p, "_k", "input_ids", 0.15, SEED)
    return m.select("conv_id", "turn", "sentence", tk.ids_text("input_ids").alias("input_ids"),
                    tk.ids_text("mlm_input_ids").alias("mlm_input_ids"), tk.ids_text("mlm_labels").alias("mlm_labels"))


def _sentences(spark, sf):
    """Both sentences of every pair, one row each."""
    return views.pairs(spark, sf).select("conv_id", "turn", F.posexplode(F.array("sent0", "sent1")).alias("sentence", "text"))


_TOK64 = " UNION ALL ".join(f"SELECT conv_id, turn, CAST({n} AS INTEGER) AS sentence, {st.text_to_ids(f'sent{n}')} AS ids FROM pairs"
                           for n in (0, 1))


@register("token_rows_64", "F19", sql(
    f"SELECT conv_id, turn, sentence, "
    f"{st.ids_text(f'list_concat(ids[1:64], list_resize([CAST(0 AS BIGINT)], 64 - least(len(ids), 64), 0))')} "
    f"AS input_ids, "
    f"{st.ids_text('list_concat(list_resize([1], least(len(ids), 64), 1), list_resize([0], 64 - least(len(ids), 64), 0))')} "
    f"AS attention_mask FROM ({_TOK64})", "pairs"))
def q_token_rows(spark, sf):
    p = _sentences(spark, sf).select("conv_id", "turn", "sentence", tk.text_to_ids("text").alias("ids"))
    return p.select("conv_id", "turn", "sentence", tk.ids_text(tk.truncate_pad("ids", 64)).alias("input_ids"),
                    tk.ids_text(tk.attention_mask("ids", 64)).alias("attention_mask"))
