"""Registered queries: lexical and dense retrieval, metrics, embeddings,
pooling, next-item evaluation, contrastive loss and search test sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense as dn
from ..operators import embed as em
from ..operators import lexical as lx
from ..operators import metrics as mt
from ..operators import nextitem as ni
from ..operators import testsets as ts
from ..operators import vectorstore as vs
from ..operators.textprep import clean_item_text_rec, clean_item_text_search
from ..session import shared, stable, stored, workdir
from ..sources import views
from . import sqltext as st
from .catalog import register
from .q_sequences import _ITEMS, _SEQ, _seqs
from .q_text import _REC_SQL, _SEARCH_SQL
from .sqlviews import sql

SEED = 42


# ------------------------------------------------------------------ lexical
def _bm25_ctes(length_norm: str):
    length = "n / avgdl" if length_norm == "corpus" else "p.dl / avgdl"
    return (
        ("bm_docs", f"SELECT doc_id, {st.tokens_sw('text')} AS toks FROM corpus"),
        ("bm_n", "SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM bm_docs"),
        ("bm_post", "SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM "
                    "(SELECT doc_id, unnest(toks) AS term, len(toks) AS dl FROM bm_docs) GROUP BY doc_id, term"),
        ("bm_idf", "SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf "
                   "FROM bm_post, bm_n GROUP BY term"),
        ("bm_terms", "SELECT term, df, idf, CASE WHEN idf >= 0 THEN idf ELSE 0.25 * (SELECT avg(idf) FROM bm_idf) END "
                     "AS idf_used FROM bm_idf"),
        ("bm_q", f"SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({st.tokens_sw('query')}) AS term "
                 "FROM search_queries) GROUP BY ALL"),
        ("bm_scores", "SELECT q.qid, p.doc_id, sum(q.qtf * t.idf_used * p.tf * 2.5 / "
                      f"(p.tf + 1.5 * (1 - 0.75 + 0.75 * {length}))) AS score "
                      "FROM bm_q q JOIN bm_terms t USING (term) JOIN bm_post p USING (term), bm_n GROUP BY ALL"),
        ("bm_ranked", "SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER "
                      "(PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm_scores"),
    )


@register("passage_targets", "S-view J3", sql("SELECT qid, query, target FROM search_queries", "search_queries"))
def q_passage_targets(spark, sf):
    return views.search_queries(spark, sf)


def _index(spark, sf):
    """The inverted index that all lexical queries read, built once an application."""
    return shared(spark, "bm25", views.source(sf, "documents"), lambda: lx.build_bm25(views.corpus(spark, sf)))


def _search_queries(spark, sf):
    return shared(spark, "search_queries", views.source(sf, "documents", "benchmark"),
                  lambda: stored(views.search_queries(spark, sf)))


@register("term_stats", "A8 F15", sql(
    "SELECT term, df, round(idf, 6) AS idf, round(idf_used, 6) AS idf_used FROM bm_terms", "corpus",
    extra=_bm25_ctes("corpus")[:5]))
def q_term_stats(spark, sf):
    idx = _index(spark, sf)
    return idx.terms.select("term", "df", F.round("idf", 6).alias("idf"), F.round("idf_used", 6).alias("idf_used"))


def _bm25(spark, sf, k, length_norm):
    return lx.bm25_search(_index(spark, sf), _search_queries(spark, sf), k, length_norm=length_norm)


@register("bm25_top10", "D13 J6 W6", sql(
    "SELECT qid, doc_id, rank, score FROM bm_ranked WHERE rank <= 10", "corpus", "search_queries",
    extra=_bm25_ctes("corpus")))
def q_bm25_top10(spark, sf):
    return _bm25(spark, sf, 10, "corpus").select("qid", "doc_id", "rank", "score")


@register("bm25_top10_doclen", "D13", sql(
    "SELECT qid, doc_id, rank, score FROM bm_ranked WHERE rank <= 10", "corpus", "search_queries",
    extra=_bm25_ctes("document")))
def q_bm25_top10_doclen(spark, sf):
    return _bm25(spark, sf, 10, "document").select("qid", "doc_id", "rank", "score")


_NDCG_BY = """
    SELECT CASE WHEN GROUPING(category) = 1 THEN '__all__' ELSE CAST(category AS VARCHAR) END AS category,
           count(*) AS n_queries, round(avg(ndcg), 6) AS ndcg_{k}, round(avg(hit), 6) AS recall_{k}
    FROM (SELECT t.category, CASE WHEN r.rank <= {k} THEN 1.0 / log2(r.rank + 1) ELSE 0.0 END AS ndcg,
                 CASE WHEN r.rank <= {k} THEN 1.0 ELSE 0.0 END AS hit
          FROM {targets} t LEFT JOIN {ranked} r ON r.{qid} = t.{qid} AND r.{item} = t.target)
    GROUP BY GROUPING SETS ((category), ())"""


@register("bm25_ndcg", "D18 W7 A9 F11", sql(
    _NDCG_BY.format(k=100, targets="bm_targets", ranked="bm_ranked", qid="qid", item="doc_id"),
    "corpus", "search_queries",
    extra=_bm25_ctes("corpus") + (("bm_targets", "SELECT s.qid, s.target, c.category FROM search_queries s "
                                                  "JOIN corpus c ON c.doc_id = s.target"),)))
def q_bm25_ndcg(spark, sf):
    ranked = _bm25(spark, sf, 100, "corpus")
    targets = _search_queries(spark, sf).join(
        views.corpus(spark, sf).select(F.col("doc_id").alias("target"), "category"), "target")
    per_q = mt.with_metrics(mt.rank_of_target(ranked, targets, "qid", "doc_id", "target"), [100])
    return mt.mean_metric(per_q, "category", ["ndcg_100", "recall_100"])


# ------------------------------------------------------------------ dense
_DENSE = (
    ("dq", "SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v, label FROM vectors WHERE vec_id % 10 = 0"),
    ("di", "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v, label FROM vectors"),
    ("ds", f"SELECT qid, item_id, {st.cosine('q.v', 'i.v')} AS score FROM dq q, di i"),
    ("dranked", "SELECT qid, item_id, round(score, 6) AS score, row_number() OVER "
                "(PARTITION BY qid ORDER BY round(score, 6) DESC, item_id) AS rank FROM ds"),
)


def _dense_inputs(spark, sf):
    v = views.vectors(spark, sf)
    q = v.filter(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), "label")
    i = v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")
    return q, i


@register("dense_top10", "D14 J5 F12 F13 W6", sql(
    "SELECT qid, item_id, rank, score FROM dranked WHERE rank <= 10", "vectors", extra=_DENSE))
def q_dense_top10(spark, sf):
    q, i = _dense_inputs(spark, sf)
    return dn.dense_rank(q, i, 10).select("qid", "item_id", "rank", "score")


@register("dense_top10_grid", "D14 J5", sql(
    "SELECT qid, item_id, rank, score FROM dranked WHERE rank <= 10", "vectors", extra=_DENSE))
def q_dense_top10_grid(spark, sf):
    q, i = _dense_inputs(spark, sf)
    return dn.dense_rank(q, i, 10, strategy="grid").select("qid", "item_id", "rank", "score")


@register("dense_ndcg_by_label", "D14 D18 A9", sql(
    _NDCG_BY.format(k=100, targets="dtargets", ranked="dranked", qid="qid", item="item_id"), "vectors",
    extra=_DENSE + (("dtargets", "SELECT q.qid, q.qid + 1 AS target, t.label AS category FROM dq q "
                                 "JOIN di t ON t.item_id = q.qid + 1"),)))
def q_dense_ndcg(spark, sf):
    q, i = _dense_inputs(spark, sf)
    ranked = dn.dense_rank(q, i, 100)
    targets = q.select("qid", (F.col("qid") + 1).alias("target")).join(
        i.select(F.col("item_id").alias("target"), F.col("label").alias("category")), "target")
    per_q = mt.with_metrics(mt.rank_of_target(ranked, targets, "qid", "item_id", "target"), [100])
    return mt.mean_metric(per_q, "category", ["ndcg_100", "recall_100"])


@register("threshold_search", "T1 D16", sql(
    "SELECT qid, item_id, rank, score FROM (SELECT qid, item_id, round(score, 6) AS score, row_number() OVER "
    "(PARTITION BY qid ORDER BY round(score, 6) DESC, item_id) AS rank FROM ds WHERE score >= 0.25) WHERE rank <= 5",
    "vectors", extra=_DENSE[:3]))
def q_threshold_search(spark, sf):
    q, i = _dense_inputs(spark, sf)
    return dn.threshold_search(q, i, 0.25, 5).select("qid", "item_id", "rank", "score")


@register("pairwise_similarity", "D15 F13", sql(
    f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({st.cosine('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')}, 6) "
    "AS similarity FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1", "vectors"))
def q_pairwise(spark, sf):
    v = views.vectors(spark, sf)
    a = v.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = v.select((F.col("vec_id") - 1).alias("a_id"), F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return dn.aligned_similarity(a.join(b, "a_id"), "a", "b").select(
        "a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@register("ivf_search_all_cells", "D17", sql(
    "SELECT qid, item_id, rank, score FROM dranked WHERE rank <= 10", "vectors", extra=_DENSE))
def q_ivf_all(spark, sf):
    q, i = _dense_inputs(spark, sf)
    assign, cents = dn.build_ivf(i, "item_id", "vec", n_cells=8, seed=SEED)
    return dn.ivf_search(assign, cents, q, 10, n_probe=cents.shape[0]).select("qid", "item_id", "rank", "score")


def _store(spark, sf):
    """The stored cell index over all vectors, built and measured once an application."""
    def build():
        q, i = _dense_inputs(spark, sf)
        return vs.build_store(i.select("item_id", "vec", "label"), workdir(spark, "vectors"), keep=["label"], queries=q.select("qid", "vec"), seed=SEED)
    return shared(spark, "vector_store", views.source(sf, "embeddings"), build)


@register("ivf_search_probe2", "D17")
def q_ivf_probe(spark, sf):
    # as many cells are probed as recall needs (the name is from when it was two)
    store = vs.open_store(spark, _store(spark, sf).path)
    q, _ = _dense_inputs(spark, sf)
    return vs.search(store, q, 10).select("qid", "item_id", "rank", "score")


@register("vector_store_threshold", "D16 D17 T1", sql(
    "SELECT qid, item_id, rank, score, l.label FROM (SELECT qid, item_id, round(score, 6) AS score, row_number() OVER "
    "(PARTITION BY qid ORDER BY round(score, 6) DESC, item_id) AS rank FROM ds WHERE score >= 0.25) r "
    "JOIN vectors l ON l.vec_id = r.item_id WHERE rank <= 5", "vectors", extra=_DENSE[:3]))
def q_store_threshold(spark, sf):
    store = _store(spark, sf)
    q, _ = _dense_inputs(spark, sf)
    hits = vs.search(store, q, 5, threshold=0.25, n_probe=len(store.centroids))
    return hits.select("qid", "item_id", "rank", "score", "label")


@register("vector_store_append", "U3 D17", sql(
    "SELECT qid, item_id, rank, score FROM dranked WHERE rank <= 10", "vectors", extra=_DENSE))
def q_store_append(spark, sf):
    """Half of the vectors (by id hash) are indexed first, the others appended; all cells are searched."""
    q, i = _dense_inputs(spark, sf)
    first = F.pmod(F.xxhash64("item_id"), F.lit(2)) == 0
    store = vs.build_store(i.filter(first), workdir(spark, "vectors"), queries=q.select("qid", "vec"), seed=SEED)
    vs.append(store, i.filter(~first))
    return vs.search(store, q, 10, n_probe=len(store.centroids)).select("qid", "item_id", "rank", "score")


# ------------------------------------------------------------------ pooling / embedding
_POOL = ("SELECT vec_id // 10 AS sentence, CAST(d - 1 AS INTEGER) AS dim, round(avg(x), 6) AS value FROM "
         "(SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d "
         "FROM vectors{where}) GROUP BY ALL")


def _long(df, key, vec, out_key=None, nonzero=False):
    """One row a component (only those that do not round to zero with ``nonzero``). Without ``outer`` Spark
    filters the rows on the size of ``vec`` first, for which it computes the whole vector a second time."""
    x = df.select(F.col(key).alias(out_key or key), F.posexplode_outer(vec).alias("dim", "value")).filter(F.col("dim").isNotNull())
    if nonzero:
        x = x.filter((F.col("value") != 0) & (F.round("value", 6) != 0))
    return x.select(out_key or key, "dim", F.round("value", 6).alias("value"))


def _pool(spark, sf, skip_first):
    v = views.vectors(spark, sf).select(F.expr("vec_id div 10").alias("sentence"),
                                        (F.col("vec_id") % 10).alias("pos"), "embedding")
    pooled = em.mean_pool(v, "sentence", "embedding", position="pos", skip_first=skip_first)
    return _long(pooled, "sentence", "pooled")


@register("mean_pool", "A11", sql(_POOL.format(where=""), "vectors"))
def q_mean_pool(spark, sf):
    return _pool(spark, sf, False)


@register("mean_of_layers", "A11", sql(
    "SELECT a.vec_id AS sentence, CAST(d - 1 AS INTEGER) AS dim, round((a.x + b.x) / 2, 6) AS value FROM "
    "(SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM vectors) a JOIN "
    "(SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM vectors) b "
    "USING (d) WHERE b.vec_id = a.vec_id + 1", "vectors"))
def q_mean_of_layers(spark, sf):
    v = views.vectors(spark, sf).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return _long(pairs.select("vec_id", em.mean_of_layers("v", "w").alias("m")), "vec_id", "m", "sentence")


@register("mean_pool_skip_first", "A11", sql(_POOL.format(where=" WHERE vec_id % 10 > 0"), "vectors"))
def q_mean_pool_skip(spark, sf):
    return _pool(spark, sf, True)


_ITEM_TEXT = ("item_rec_text", f"SELECT parent_asin, {_REC_SQL} AS text FROM items")


@register("embed_text_hash", "D19 X4", sql(
    "SELECT parent_asin, CAST(d AS INTEGER) AS dim, round(v, 6) AS value FROM item_vec_long", "items",
    extra=(_ITEM_TEXT, ("item_vec_long", st.hash_long("item_rec_text", "parent_asin", "text")))))
def q_embed_text(spark, sf):
    # a million short rows are one small file: they are spread before they are cleaned and encoded
    items = views.items(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    txt = clean_item_text_rec(items).withColumnRenamed("cleaned_metadata", "text")
    vecs = em.embed_text(txt, "text", "vec")
    return _long(vecs, "parent_asin", "vec", nonzero=True)


# ------------------------------------------------------------------ next item
_NEXT = (
    _ITEM_TEXT,
    ("item_vec_long", st.hash_long("item_rec_text", "parent_asin", "text")),
    ("item_vec", st.dense_from_long("item_rec_text", "parent_asin", "item_vec_long")),
    ("test_rows", "SELECT CAST(user_id AS VARCHAR) || '|' || CAST(parent_asin AS VARCHAR) AS row_id, "
                  "parent_asin AS target, h FROM seq_rows WHERE split = 'test'"),
    ("user_long", "SELECT row_id, d, sum(v) / max(len(h)) AS v FROM "
                  "(SELECT row_id, h, unnest(h) AS parent_asin FROM test_rows) r JOIN item_vec_long l USING (parent_asin) "
                  "GROUP BY row_id, d"),
    ("user_vec", st.dense_from_long("test_rows", "row_id", "user_long")),
    ("nscores", f"SELECT u.row_id, i.parent_asin, round({st.cosine('u.vec', 'i.vec')}, 6) AS score "
                "FROM user_vec u, item_vec i"),
    ("nranked", "SELECT * FROM (SELECT row_id, parent_asin, row_number() OVER (PARTITION BY row_id "
                "ORDER BY score DESC, parent_asin) AS rank FROM nscores) WHERE rank <= 50"),
    ("per_row", "SELECT t.row_id, r.rank FROM test_rows t LEFT JOIN nranked r "
                "ON r.row_id = t.row_id AND r.parent_asin = t.target"),
)
_NEXT_BODY = " UNION ALL ".join(
    f"SELECT '{m}_{k}' AS metric, round(avg(CASE WHEN rank <= {k} THEN {v} ELSE 0.0 END), 6) AS value FROM per_row"
    for k in (10, 50) for m, v in (("recall", "1.0"), ("ndcg", "1.0 / log2(rank + 1)")))


@register("next_item_eval", "D20 D19 A11", sql(_NEXT_BODY, "interactions", "items", "thresholds",
                                               extra=(_SEQ, *_NEXT)))
def q_next_item(spark, sf):
    items = views.items(spark, sf)
    rows = stable(_seqs(spark, sf).filter(F.col("split") == "test").select(
        F.concat_ws("|", "user_id", "parent_asin").alias("row_id"), F.col("parent_asin").alias("target"), "history"))
    text = clean_item_text_rec(items).select(F.col("parent_asin").alias("item_id"), "cleaned_metadata")
    item_vecs = em.embed_text(text, "cleaned_metadata", "vec").select("item_id", "vec")
    per_row = ni.evaluate_from_histories(rows, item_vecs, "row_id", "history", "target", "item_id", "vec")
    return ni.summarize(per_row)


# ------------------------------------------------------------------ contrastive
_CON = (
    ("cp", "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, conv_id, turn, sent0, sent1 FROM pairs"),
    ("ca_long", st.hash_long("cp", "pos", "sent0")),
    ("cb_long", st.hash_long("cp", "pos", "sent1")),
    ("ca", st.dense_from_long("cp", "pos", "ca_long")),
    ("cb", st.dense_from_long("cp", "pos", "cb_long")),
    ("cl", f"SELECT x.pos // 16 AS batch, x.pos, ln(sum(exp({st.cosine('x.vec', 'y.vec')} / 0.05))) - "
           f"max(CASE WHEN x.pos = y.pos THEN {st.cosine('x.vec', 'y.vec')} / 0.05 END) AS loss "
           "FROM ca x JOIN cb y ON x.pos // 16 = y.pos // 16 GROUP BY 1, 2"),
)


@register("in_batch_contrastive", "D23 A12", sql(
    "SELECT count(*) AS n_batches, round(avg(bl), 6) AS loss, round(-avg(bl), 6) AS objective "
    "FROM (SELECT batch, avg(loss) AS bl FROM cl GROUP BY batch)",
    "pairs", extra=_CON))
def q_contrastive(spark, sf):
    losses = mt.in_batch_contrastive(views.pairs(spark, sf), ["conv_id", "turn"], "a", "b", batch_size=16, temp=0.05,
                                     encode=lambda x: em.embed_text(em.embed_text(x, "sent0", "a"), "sent1", "b"))
    return mt.mean_of_batches(losses)


# ------------------------------------------------------------------ search test sets
_SEARCH_TS = (
    ("kept", "SELECT j.*, c.category FROM judgements j JOIN category_map c ON c.item_id = j.product_id "
             "WHERE product_locale = 'us' AND relevance_label = 'Exact' AND small_version = 1 "
             "AND NOT contains(c.category, 'Unknown')"),
    ("tq", f"SELECT row_number() OVER (ORDER BY query, product_id) - 1 AS qid, "
           f"replace({st.strip('query')}, chr(9), ' ') AS query, product_id AS item_id, category FROM kept"),
)


def _neg_ctes(queries: str, cats: str, n: int):
    return (
        ("cpos", f"SELECT item_id, category, row_number() OVER (PARTITION BY category ORDER BY "
                 f"md5(CAST(item_id AS VARCHAR) || '|{SEED}'), item_id) - 1 AS cat_pos, "
                 f"count(*) OVER (PARTITION BY category) AS cat_size FROM {cats}"),
        ("csizes", "SELECT category, max(cat_size) AS cat_size FROM cpos GROUP BY 1"),
        ("negs", f"SELECT q.qid, q.category, p.item_id AS neg_item FROM "
                 f"(SELECT t.qid, t.category, s.cat_size, "
                 f"{st.hash32(f'CAST(t.qid AS VARCHAR) || {st.lit(chr(124) + str(SEED))}')} % s.cat_size AS st, "
                 f"unnest(range(least({n}, s.cat_size))) AS j FROM {queries} t JOIN csizes s USING (category)) q "
                 "JOIN cpos p ON p.category = q.category AND p.cat_pos = (q.st + q.j) % q.cat_size"),
        ("pool", f"SELECT DISTINCT item_id, category FROM (SELECT item_id, category FROM {queries} "
                 "UNION ALL SELECT neg_item, category FROM negs)"),
        ("item_search_text", f"SELECT parent_asin AS item_id, {_SEARCH_SQL} AS metadata FROM items"),
    )


@register("filter_judgements", "P3 J3 F14", sql(
    "SELECT query, product_id, category FROM kept", "judgements", "category_map", extra=_SEARCH_TS[:1]))
def q_filter_judgements(spark, sf):
    return ts.filter_judgements(views.judgements(spark, sf), views.category_map(spark, sf)).select(
        "query", "product_id", "category")


def _search_ts(spark, sf):
    items = views.items(spark, sf)
    text = clean_item_text_search(items).join(items.select("parent_asin", "category"), "parent_asin").select(
        F.col("parent_asin").alias("item_id"), "category", F.col("cleaned_metadata").alias("metadata"))
    # items are listed under a second category with another text, which belongs to that category's pool only
    other = text.select("item_id", F.lit("Brand#11").alias("category"), F.concat(F.lit("second "), "metadata").alias("metadata")) \
        .filter(F.col("item_id") % 3 == 0).join(text.select("item_id", "category"), ["item_id", "category"], "left_anti")
    return ts.build_search_testset(views.judgements(spark, sf), views.category_map(spark, sf), text.unionByName(other), n_neg=5, seed=SEED)


@register("search_testset_queries", "D11 W8 P13", sql(
    "SELECT qid, query, item_id FROM tq", "judgements", "category_map", extra=_SEARCH_TS))
def q_search_ts_queries(spark, sf):
    return _search_ts(spark, sf).queries


@register("search_testset_pool", "D11 J8 U4 J7", sql(
    "SELECT p.item_id, p.category, t.metadata FROM pool p JOIN (SELECT x.item_id, i.category, x.metadata FROM item_search_text x "
    "JOIN items i ON i.parent_asin = x.item_id UNION ALL SELECT x.item_id, 'Brand#11', 'second ' || x.metadata FROM item_search_text x "
    "JOIN items i ON i.parent_asin = x.item_id WHERE x.item_id % 3 = 0 AND i.category <> 'Brand#11') t USING (item_id, category)",
    "judgements", "category_map", "items", extra=_SEARCH_TS + _neg_ctes("tq", "category_map", 5)))
def q_search_ts_pool(spark, sf):
    return _search_ts(spark, sf).pool


_COMPLEX = (
    ("picked", f"SELECT * FROM reviews WHERE rating >= 5 AND length(text) >= 100 ORDER BY "
               f"md5(CAST(user_id AS VARCHAR) || '|' || CAST(parent_asin AS VARCHAR) || '|{SEED}'), user_id, parent_asin "
               "LIMIT 200"),
    ("cq", "SELECT row_number() OVER (ORDER BY user_id, parent_asin) - 1 AS qid, text AS query, parent_asin AS item_id, "
           "user_id, rating AS ori_rating, c.category FROM picked JOIN category_map c ON c.item_id = picked.parent_asin"),
)


def _complex(spark, sf):
    text = clean_item_text_search(views.items(spark, sf)).select(
        F.col("parent_asin").alias("item_id"), F.col("cleaned_metadata").alias("metadata"))
    return ts.build_complex_query_pool(views.reviews(spark, sf), views.category_map(spark, sf), text, 200, 5, SEED)


@register("complex_query_pool", "D12 P2 P7 J8 U4", sql(
    "SELECT p.item_id, p.category, t.metadata FROM pool p JOIN item_search_text t USING (item_id)",
    "reviews", "category_map", "items", extra=_COMPLEX + _neg_ctes("cq", "category_map", 5)))
def q_complex_pool(spark, sf):
    return _complex(spark, sf).pool


@register("complex_queries", "D12", sql(
    "SELECT qid, item_id, user_id, ori_rating, length(query) AS query_chars FROM cq", "reviews", "category_map",
    extra=_COMPLEX))
def q_complex_queries(spark, sf):
    return _complex(spark, sf).queries.select("qid", "item_id", "user_id", "ori_rating",
                                             F.length("query").cast("bigint").alias("query_chars"))


# ------------------------------------------------------------------ J9, A6, A7, D16
@register("aligned_item_vectors", "J9 D6", sql(
    """SELECT m.iid AS id, round(coalesce(sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]),
                                                     CAST(v.embedding AS DOUBLE[]))), 0.0), 6) AS norm
       FROM (SELECT iid FROM item_map UNION ALL SELECT 0) m LEFT JOIN vectors v ON v.vec_id = m.iid - 1""",
    "interactions", "items", "thresholds", "vectors", extra=(_SEQ, _ITEMS)))
def q_aligned_vectors(spark, sf):
    from ..operators.sequences import remap_items

    items_map = remap_items(_seqs(spark, sf))
    vecs = views.vectors(spark, sf).select(F.col("vec_id").alias("row"), F.col("embedding").alias("vec"))
    out = dn.align_vectors(items_map.select(F.col("iid").alias("id")), vecs, 64)
    return out.select("id", F.round(dn.norm("vec"), 6).alias("norm"))


@register("corpus_stats", "A6", """
    SELECT 'n_queries' AS metric, CAST(count(*) AS DOUBLE) AS value FROM benchmark
    UNION ALL SELECT 'n_items', CAST(count(*) AS DOUBLE) FROM documents
    UNION ALL SELECT 'mean_query_chars', round(avg(length(text)), 2) FROM benchmark
    UNION ALL SELECT 'mean_item_chars', round(avg(length(text)), 2) FROM documents""")
def q_corpus_stats(spark, sf):
    return mt.corpus_stats(views.table(spark, sf, "benchmark").withColumnRenamed("text", "query"),
                           views.table(spark, sf, "documents"))


@register("items_by_category", "A7", sql(
    "SELECT category, count(DISTINCT item_id) AS n_items FROM category_map GROUP BY 1", "category_map"))
def q_items_by_category(spark, sf):
    return mt.items_by_category(views.category_map(spark, sf))


@register("category_items", "A7", sql(
    "SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY item_id) AS position "
    "FROM (SELECT DISTINCT category, item_id FROM category_map)", "category_map"))
def q_category_items(spark, sf):
    return mt.category_items(views.category_map(spark, sf))


_IDX = (
    ("doc_long", st.hash_long("documents", "doc_id", "text")),
    ("doc_vec", st.dense_from_long("documents", "doc_id", "doc_long")),
    ("bq_long", st.hash_long("benchmark", "item_id", "text")),
    ("bq_vec", st.dense_from_long("benchmark", "item_id", "bq_long")),
    ("iscores", f"SELECT q.item_id AS qid, d.doc_id, {st.cosine('q.vec', 'd.vec')} AS score FROM bq_vec q, doc_vec d"),
)


@register("index_search", "D16 T1 U3 X4", sql(
    "SELECT qid, r.doc_id, rank, score, d.text AS sentence FROM (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER "
    "(PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM iscores WHERE score >= 0.5) r "
    "JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 5",
    extra=_IDX))
def q_index_search(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0   # never null: every document is in one half
    index = dn.add_to_index(dn.build_index(docs.filter(first), "doc_id", "text"), dn.build_index(docs.filter(~first), "doc_id", "text"))
    queries = dn.build_index(views.table(spark, sf, "benchmark"), "item_id", "text").select(
        F.col("item_id").alias("qid"), F.col("embedding").alias("vec"))
    hits = dn.threshold_search(queries, index.select("doc_id", F.col("embedding").alias("vec")), 0.5, 5, item="doc_id")
    return hits.join(docs.withColumnRenamed("text", "sentence"), "doc_id").select("qid", "doc_id", "rank", "score", "sentence")
