"""Registered queries of the sources and sinks (S1-S10, K1-K9): each writes rows of the
driver's tables to the session's shared folder, reads them back with the matching reader and
is compared with the tables themselves. Also the per-category forms of splits and core."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import interactions as ops
from ..operators import metrics as mt
from ..operators import userlog
from ..session import ensure_checkpoint_dir
from ..sources import readers, views, writers
from .catalog import register
from .q_interactions import K, _hist, kcore_sql
from .sqlviews import sql

CATEGORIES = 5   # fixture: the category of an interaction is its item id modulo this


def _dir(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}/{name}"


def _by_category(spark, sf):
    return views.interactions(spark, sf).withColumn("category", F.concat(F.lit("c"), F.col("parent_asin") % CATEGORIES))


_CAT_SQL = f"'c' || CAST(parent_asin % {CATEGORIES} AS VARCHAR)"
_RATING = "CAST(user_id AS VARCHAR) AS user_id, CAST(parent_asin AS VARCHAR) AS parent_asin, rating, \"timestamp\""


@register("io_ratings_csv", "S2 S3 K1", sql(f"SELECT {_RATING}, {_CAT_SQL} AS category FROM interactions", "interactions"))
def q_ratings(spark, sf):
    path = writers.write_ratings(_by_category(spark, sf), _dir(spark, "out"), 0)
    return readers.read_ratings_csv(spark, path)


_SPLIT = "CASE WHEN n_user = rn THEN 'test' WHEN n_user - rn = 1 THEN 'valid' ELSE 'train' END"


@register("io_splits_history", "S2 K2", sql(f"SELECT {_RATING}, {_SPLIT} AS split, {_hist(5)} AS history FROM ranked", "ranked"))
def q_splits(spark, sf):
    out = userlog.last_out(views.user_log(spark, sf), history=True, max_len=5)
    path = writers.write_splits(out, _dir(spark, "splits"), with_history=True)
    return readers.read_split_csv(spark, path, with_history=True).withColumn("history", ops.history_text("history"))


@register("io_inter_tsv", "S7 K3", sql(
    f"SELECT CAST(user_id AS VARCHAR) AS user_id, {_hist(5)} AS history, CAST(parent_asin AS VARCHAR) AS parent_asin "
    "FROM interactions", "interactions"))
def q_inter(spark, sf):
    path = writers.write_inter(userlog.bounded_history(views.user_log(spark, sf), 5), _dir(spark, "train.tsv"))
    got = readers.read_text_pairs(spark, path, ("user_id", "history", "parent_asin"))
    return got.withColumn("history", F.coalesce("history", F.lit("")))


@register("io_id_maps", "K4", (
    "SELECT 'user' AS kind, CAST(c_custkey AS VARCHAR) AS token, CAST(c_custkey + 1 AS BIGINT) AS id FROM customer "
    "UNION ALL SELECT 'item', CAST(p_partkey AS VARCHAR), CAST(p_partkey + 1 AS BIGINT) FROM part "
    "UNION ALL SELECT 'meta', p_name, CAST(p_partkey + 1 AS BIGINT) FROM part "
    "UNION ALL SELECT kind, '[PAD]', 0 FROM (VALUES ('user'), ('item'), ('meta')) k(kind)"))
def q_id_maps(spark, sf):
    users = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + 1).cast("long").alias("id"))
    part = views.table(spark, sf, "part").withColumn("id", (F.col("p_partkey") + 1).cast("long"))
    path = writers.write_id_maps(users, part.select("p_partkey", "id"), _dir(spark, "maps"), id_meta=part.select("id", "p_name"))
    return spark.read.schema("kind string, token string, id long").json(path)


_VEC = ("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")


@register("io_vectors_f32", "S8 K5 T2", (
    f"SELECT id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS pos, round(unnest(e), 6) AS value FROM ({_VEC})"))
def q_vectors(spark, sf):
    vec = views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("vec"))
    path = _dir(spark, "vec")
    writers.write_vectors_f32(vec, path, "vec_id", parts=17)
    writers.write_vectors_f32(vec, path, "vec_id", parts=13)   # a rewrite with fewer parts leaves none of the old
    dim = vec.agg(F.max(F.size("vec"))).first()[0]
    got = readers.read_vectors_f32(spark, path, dim)
    return got.select("id", F.posexplode("vec").alias("pos", "v")).select(
        "id", "pos", F.round(F.col("v").cast("double"), 6).alias("value"))


@register("io_pairs_tsv", "S7 K6", (
    "SELECT replace(replace(replace(text, chr(10), ' '), chr(9), ' '), chr(13), '') || ' \"quoted, text\"' AS review, "
    "source || '\"' || lang AS meta FROM documents"))
def q_pairs(spark, sf):
    flat = F.translate(F.translate("text", "\n\t", "  "), "\r", "")
    docs = views.table(spark, sf, "documents").select(
        F.concat(flat, F.lit(' "quoted, text"')).alias("review"), F.concat("source", F.lit('"'), "lang").alias("meta"))
    return readers.read_text_pairs(spark, writers.write_pairs_tsv(docs, _dir(spark, "pairs.tsv")), ("review", "meta"))


@register("io_queries_csv", "S6 K7", (
    "SELECT doc_id AS qid, 'tv 5\", wall' || chr(10) || text AS query, '\"' || source || '\",' AS item_id FROM documents"))
def q_queries(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        F.col("doc_id").alias("qid"), F.concat(F.lit('tv 5", wall\n'), "text").alias("query"),
        F.concat(F.lit('"'), "source", F.lit('",')).alias("item_id"))
    return readers.read_queries(spark, writers.write_queries_csv(docs, _dir(spark, "queries"))).select("qid", "query", "item_id")


@register("io_item_pool", "S5 K8 A13", sql(
    "SELECT CAST(parent_asin AS VARCHAR) AS item_id, category, title AS metadata FROM items", "items"))
def q_item_pool(spark, sf):
    items = views.items(spark, sf).select(F.col("parent_asin").cast("string").alias("item_id"), "category",
                                          F.col("title").alias("metadata"))
    return readers.read_item_pool(spark, writers.write_item_pool_jsonl(items, _dir(spark, "pool")))


@register("io_reviews_jsonl", "S1 P1 F1", sql(
    f"SELECT {_RATING} FROM raw_interactions", "raw_interactions"))
def q_reviews(spark, sf):
    raw = views.raw_interactions(spark, sf)
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"),
                              F.col("parent_asin").cast("string").alias("parent_asin"), "rating",
                              F.col("timestamp").alias("sortTimestamp")))
    path = _dir(spark, "reviews")
    # a blank and a broken line in every file's place: skipped and rejected
    raw.select(line.alias("value")).unionByName(spark.createDataFrame([("",), ("{broken",)], "value string")).write.text(path)
    return readers.read_reviews_jsonl(spark, path)[0]


@register("io_json_map", "S4", "SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_brand AS category FROM part")
def q_json_map(spark, sf):
    part = views.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_brand")
    path = _dir(spark, "map")
    # maps of a thousand items each: one file per partition and line
    grouped = part.groupBy(F.floor(F.col("k").cast("long") / 1000).alias("g")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "p_brand")))).alias("value"))
    grouped.select("value").repartition(grouped.select("g").distinct().count(), "value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json_map(spark, path)


@register("io_lines", "S9", "SELECT rtrim(p_name || ' ' || p_type) AS text FROM part")
def q_lines(spark, sf):
    path = _dir(spark, "lines.txt")
    views.table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), "p_type", F.lit(" \t ")).alias("value")).write.text(path)
    return readers.read_lines(spark, path)


@register("io_category_list", "S10", "SELECT p_brand AS category FROM part")
def q_categories(spark, sf):
    path = _dir(spark, "categories.txt")
    views.table(spark, sf, "part").select(F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("value")).write.text(path)
    return readers.read_category_list(spark, path)


@register("io_metrics", "K9", sql(
    "SELECT 'items_' || category || ' = ' || CAST(count(DISTINCT item_id) AS VARCHAR) AS value FROM category_map GROUP BY category",
    "category_map"))
def q_metrics(spark, sf):
    table = mt.items_by_category(views.category_map(spark, sf)).select(
        F.concat(F.lit("items_"), "category").alias("metric"), F.col("n_items").alias("value"))
    return spark.read.text(writers.write_metrics(table, _dir(spark, "report")))


_LAST_CAT = ("SELECT user_id, parent_asin, rating, \"timestamp\", seq, category, CASE WHEN back = 1 THEN 'test' WHEN back = 2 "
             "THEN 'valid' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY category, user_id ORDER BY "
             f"\"timestamp\" DESC, parent_asin DESC) AS back FROM (SELECT *, {_CAT_SQL} AS category FROM interactions))")


@register("last_out_by_category", "W2 W3 D3", sql(_LAST_CAT, "interactions"))
def q_last_out_category(spark, sf):
    return ops.per_category(_by_category(spark, sf), "category", lambda x, user, item: ops.last_out(x, user=user, item=item))


def _core_category_sql():
    # the plain core over ids made unique per category, which are then taken apart again
    text = kcore_sql(3, 3, rounds=16).replace(
        'SELECT user_id, parent_asin, rating, "timestamp", seq FROM interactions',
        f"SELECT user_id * {CATEGORIES} + parent_asin % {CATEGORIES} AS user_id, parent_asin, rating, \"timestamp\", seq FROM interactions")
    return text.replace("SELECT * FROM e16", f"SELECT user_id // {CATEGORIES} AS user_id, parent_asin, rating, \"timestamp\", seq, "
                                             f"{_CAT_SQL} AS category FROM e16")


@register("k_core_by_category", "A2 D1", _core_category_sql())
def q_core_category(spark, sf):
    return ops.per_category(_by_category(spark, sf), "category", lambda x, user, item: ops.k_core(x, 3, 3, user, item).edges)


@register("rating_only_core", "D1", kcore_sql(K, K))
def q_rating_only(spark, sf):
    return ops.build_rating_only(views.raw_interactions(spark, sf), K)[1].edges


@register("at_least_counts", "A4", sql(
    "SELECT user_id, count(*) AS n_interactions FROM interactions GROUP BY 1 HAVING count(*) >= 45", "interactions"))
def q_at_least(spark, sf):
    return ops.degree_threshold(ops.user_counts(views.interactions(spark, sf)), 45)[0]
