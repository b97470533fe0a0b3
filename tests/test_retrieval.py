import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsift.operators import dense as dn
from recsift.operators import embed as em
from recsift.operators import lexical as lx
from recsift.operators import metrics as mt


def test_ndcg_values(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 11)], "q int, rank int")
    got = {r.q: (r.ndcg_10, r.recall_10) for r in mt.with_metrics(df, [10]).collect()}
    assert got[1] == (1.0, 1.0)
    assert abs(got[2][0] - 0.5) < 1e-12 and got[2][1] == 1.0
    assert got[3] == (0.0, 0.0) and got[4] == (0.0, 0.0)


def test_mean_metric_grouping_sets(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "category string, m double")
    got = {r.category: (r.n_queries, r.m) for r in mt.mean_metric(df, "category", ["m"]).collect()}
    assert got == {"a": (2, 0.5), "b": (1, 1.0), "__all__": (3, round(2 / 3, 6))}


def _vecs(spark, rows, key="item_id"):
    return spark.createDataFrame(rows, f"{key} long, vec array<float>")


def test_zero_vector_scores_zero(spark):
    q = _vecs(spark, [(1, [1.0, 0.0])], "qid")
    items = _vecs(spark, [(10, [0.0, 0.0]), (11, [1.0, 0.0])])
    got = {r.item_id: r.score for r in dn.dense_rank(q, items, 5).collect()}
    assert got == {10: 0.0, 11: 1.0}
    n = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(dn.l2_normalize("v").alias("u")).first().u
    assert n == [0.0, 0.0]


def test_threshold_search(spark):
    # cosines .9, .6, .59 against the query (1, 0)
    def v(c):
        return [c, math.sqrt(1 - c * c)]
    q = _vecs(spark, [(1, [1.0, 0.0])], "qid")
    idx = _vecs(spark, [(10, v(0.9)), (11, v(0.6)), (12, v(0.59))])
    got = [r.item_id for r in dn.threshold_search(q, idx, 0.6, 5).orderBy("rank").collect()]
    assert got == [10, 11]


def test_dense_strategies_agree_and_match_numpy(spark):
    rnd = np.random.default_rng(0)
    qv, iv = rnd.normal(size=(30, 8)), rnd.normal(size=(200, 8))
    q = _vecs(spark, [(i, qv[i].tolist()) for i in range(30)], "qid")
    items = _vecs(spark, [(100 + i, iv[i].tolist()) for i in range(200)])
    res = {}
    for strategy in ("broadcast", "grid"):
        res[strategy] = sorted((r.qid, r.item_id, r.rank) for r in dn.dense_rank(q, items, 5, strategy=strategy).collect())
    assert res["broadcast"] == res["grid"]
    qn = qv / np.linalg.norm(qv, axis=1, keepdims=True)
    inn = iv / np.linalg.norm(iv, axis=1, keepdims=True)
    s = np.round(qn.astype(np.float32).astype(np.float64) @ inn.T, 6)
    top = {(qi, 100 + int(j)) for qi in range(30) for j in np.argsort(-s[qi], kind="stable")[:5]}
    assert {(a, b) for a, b, _ in res["grid"]} == top


def test_ivf_all_cells_equals_exact(spark):
    rnd = np.random.default_rng(1)
    q = _vecs(spark, [(i, rnd.normal(size=6).tolist()) for i in range(20)], "qid")
    items = _vecs(spark, [(100 + i, rnd.normal(size=6).tolist()) for i in range(150)])
    exact = sorted(tuple(r) for r in dn.dense_rank(q, items, 4).select("qid", "item_id", "rank").collect())
    assign, cents = dn.build_ivf(items, n_cells=6, seed=3)
    ivf = dn.ivf_search(assign, cents, q, 4, n_probe=cents.shape[0])
    assert sorted(tuple(r) for r in ivf.select("qid", "item_id", "rank").collect()) == exact
    some = dn.ivf_search(assign, cents, q, 4, n_probe=1).count()
    assert 0 < some <= 80


def test_registered_index_search_reaches_recall(spark):
    import __spark_entry__
    from recsift.sources import views

    sf = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()["ivf_search_probe2"](spark, sf)
    v = views.vectors(spark, sf).select("vec_id", F.col("embedding").alias("vec"))
    q, items = v.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "qid"), v.withColumnRenamed("vec_id", "item_id")
    exact = {(r.qid, r.item_id) for r in dn.dense_rank(q, items, 10).collect()}
    found = {(r.qid, r.item_id) for r in got.collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert {r.qid for r in q.select("qid").collect()} <= {i for _, i in found}   # queries are indexed, too


def test_bm25_negative_idf_uses_eps(spark):
    docs = spark.createDataFrame([(1, "common alpha"), (2, "common beta"), (3, "common gamma")], "doc_id long, text string")
    idx = lx.build_bm25(docs, eps=0.25)
    terms = {r.term: (r.df, r.idf, r.idf_used) for r in idx.terms.collect()}
    assert terms["common"][0] == 3 and terms["common"][1] < 0
    assert abs(terms["common"][2] - 0.25 * idx.mean_idf) < 1e-12
    q = spark.createDataFrame([(7, "alpha alpha common")], "qid long, query string")
    ranked = lx.top_k(lx.bm25_scores(idx, q, length_norm="corpus"), "qid", "doc_id", 10).orderBy("rank").collect()
    assert [r.doc_id for r in ranked] == [1, 2, 3]


def test_hash_vector_matches_encoder(spark):
    texts = ["Hello world hello", "", "día über 42", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    a = {r.id: r.v for r in df.select("id", em.hash_vector("t").alias("v")).collect()}
    b = {r.id: r.v for r in em.embed_text(df, "t", "v").select("id", "v").collect()}
    for i in range(3):
        assert np.allclose(a[i], b[i])
    assert abs(sum(abs(x) for x in a[0]) - 1.0) < 1e-12


def test_mean_pool_mask_and_skip_first(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 1.0], 1), (1, 1, [3.0, 5.0], 1), (1, 2, [100.0, 100.0], 0)],
                               "s int, pos int, v array<double>, m int")
    assert em.mean_pool(df, "s", "v", weight="m").first().pooled == [2.0, 3.0]
    assert em.mean_pool(df, "s", "v", weight="m", position="pos", skip_first=True).first().pooled == [3.0, 5.0]


def test_in_batch_contrastive_masks(spark):
    rows = [(i, [1.0, float(i)], [1.0, float(i)], "p" if i < 2 else f"k{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "o int, a array<double>, b array<double>, key string")
    drop = mt.in_batch_contrastive(df, ["o"], "a", "b", batch_size=4, temp=1.0, positive_key="key")
    keep = mt.in_batch_contrastive(df, ["o"], "a", "b", batch_size=4, temp=1.0)
    assert drop.first().loss < keep.first().loss
    assert mt.mean_of_batches(keep).first().n_batches == 1


def test_next_item_one_pass_equals_general_path(spark):
    from recsift.operators import nextitem as ni

    rnd = np.random.default_rng(4)
    items = spark.createDataFrame([(f"i{j}", rnd.normal(size=4).tolist()) for j in range(40)],
                                  "item_id string, vec array<double>")
    rows = spark.createDataFrame(
        [(f"r{r}", [f"i{j}" for j in rnd.choice(40, size=rnd.integers(1, 6), replace=False)], f"i{rnd.integers(0, 40)}")
         for r in range(60)], "row_id string, history array<string>, target string")
    fast = ni.evaluate_from_histories(rows, items, ks=(5, 10))
    users = ni.history_mean_vectors(rows, "row_id", "history", items, "item_id", "vec")
    general = ni.evaluate_next_item(users, items, rows, ks=(5, 10))
    a = sorted((r.row_id, r.rank) for r in fast.collect())
    b = sorted((r.row_id, r.rank) for r in general.collect())
    assert a == b
    assert any(r is not None for _, r in a)


def test_ivf_partial_probe_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    qv, iv = rnd.normal(size=(25, 6)), rnd.normal(size=(180, 6))
    q = _vecs(spark, [(i, qv[i].tolist()) for i in range(25)], "qid")
    items = _vecs(spark, [(100 + i, iv[i].tolist()) for i in range(180)])
    assign, cents = dn.build_ivf(items, n_cells=6, seed=2)
    got = sorted((r.qid, r.item_id, r.rank) for r in dn.ivf_search(assign, cents, q, 4, n_probe=2).collect())
    cell_of = {r.item_id: r.cell for r in assign.select("item_id", "cell").collect()}
    inn = iv / np.linalg.norm(iv, axis=1, keepdims=True)
    want = []
    for qi in range(25):
        u = qv[qi] / np.linalg.norm(qv[qi])
        cells = set(np.argsort(-(cents @ u), kind="stable")[:2].tolist())
        cand = [j for j in range(180) if cell_of[100 + j] in cells]
        scores = sorted(((-np.floor(float(inn[j] @ u) * 1e6 + 0.5), 100 + j) for j in cand))
        want += [(qi, item, r + 1) for r, (_, item) in enumerate(scores[:4])]
    assert got == sorted(want)


def test_align_vectors_positional_with_pad(spark):
    ids = spark.createDataFrame([(1,), (2,), (5,)], "id long")
    vecs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row long, vec array<float>")
    got = {r.id: r.vec for r in dn.align_vectors(ids, vecs, 2).collect()}
    assert got == {0: [0.0, 0.0], 1: [1.0, 2.0], 2: [3.0, 4.0], 5: [0.0, 0.0]}


def test_build_and_extend_index(spark):
    a = spark.createDataFrame([(1, "red shoe"), (2, "blue hat")], "id long, text string")
    b = spark.createDataFrame([(3, "red shoe laces")], "id long, text string")
    index = dn.add_to_index(dn.build_index(a, "id", "text"), dn.build_index(b, "id", "text"))
    rows = {r.id: r.embedding for r in index.collect()}
    assert set(rows) == {1, 2, 3}
    for v in rows.values():
        assert abs(sum(x * x for x in v) - 1.0) < 1e-9
    q = dn.build_index(spark.createDataFrame([(9, "red shoe")], "id long, text string"), "id", "text")
    hits = dn.threshold_search(q.select(F.col("id").alias("qid"), F.col("embedding").alias("vec")),
                               index.select(F.col("id").alias("item_id"), F.col("embedding").alias("vec")), 0.5, 2)
    assert [r.item_id for r in hits.orderBy("rank").collect()][0] == 1


def _corpus(spark, seed=3, n=700):
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(None if i == 5 else i, None if i == 7 else " ".join(
        ["common"] * (i != 9) + [rng.choice(words) for _ in range(int(rng.paretovariate(1) * 6) % 90)] + (["rare"] if i % 97 == 3 else [])))
        for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("norm", ["document", "corpus"])
def test_block_max_search_equals_full_ranking(spark, norm):
    docs = _corpus(spark)
    index = lx.build_bm25(docs, block_docs=8)
    queries = spark.createDataFrame([(1, "common rare"), (2, "common"), (3, "w1 w2 w3 w3 w4"), (4, "nothing"), (5, ""), (6, None),
                                     (7, "common w7 rare rare"), (8, "w9")], "qid long, query string")
    for k in (1, 5, 40):
        full = lx.top_k(lx.bm25_scores(index, queries, length_norm=norm), "qid", "doc_id", k)
        got = lx.bm25_search(index, queries, k, length_norm=norm)
        cols = ("qid", "rank", "doc_id", "score")
        assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[c] for c in cols]) for r in full.collect())


def test_term_in_every_document_reads_few_blocks(spark):
    index = lx.build_bm25(_corpus(spark), block_docs=8)
    assert index.blocks.filter("term = 'common'").count() > 80
    queries = spark.createDataFrame([(1, "common rare")], "qid long, query string")
    qt = lx.query_terms(index, queries)
    live = lx.live_blocks(index, qt, 3)
    assert 1 <= live.count() <= 10
    # no row of the index holds more than a block of a term's documents
    assert index.blocks.agg(F.max("n")).first()[0] <= 24


@pytest.mark.parametrize("few", [True, False])
def test_passages_of_any_length(spark, monkeypatch, few):
    from recsift.operators import textmatch
    from recsift.operators.textmatch import first_containing

    monkeypatch.setattr(textmatch, "BROADCAST_KEYS", 1000 if few else 0)
    texts = ["one two three four five six", "xone twox three", "", None, "a\nb c", "one two three", "ünï cödé 漢字 text", "tail  double"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pats = ["", " ", "o", "one", "ne tw", "one two", "one two three four", "two three four five", "漢", "ï cöd", "  ", "zz", "e two three f",
            "b", None, "one two three four five six seven", "nï cödé 漢", "tail  double", "three four five six"]
    got = {r["pid"]: r["target"] for r in first_containing(
        spark.createDataFrame(list(enumerate(pats)), "pid long, p string"), docs, "pid", "p", "doc_id", "text").collect()}
    want = {i: min(j for j, t in enumerate(texts) if t is not None and p in t) for i, p in enumerate(pats)
            if p is not None and any(t is not None and p in t for t in texts)}
    assert got == want


def test_next_item_rank_does_not_depend_on_blocks(spark):
    from recsift.operators import nextitem as ni

    rng = np.random.default_rng(6)
    vecs = [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(90)]     # many ties
    items = spark.createDataFrame(vecs + [(200, None)], "item_id long, vec array<double>")
    rows = [(r, [int(x) for x in rng.integers(0, 95, rng.integers(0, 5))], int(rng.integers(0, 92))) for r in range(60)]
    df = spark.createDataFrame(rows + [(99, None, 3)], "row_id long, history array<long>, target long")
    table = dict(vecs)
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    want = {99: None}
    for r, h, t in rows:
        known = [table[x] for x in h if x in table]
        want[r] = None
        if known and t in table:
            u = unit(np.mean(known, axis=0))
            s = {i: round(float(u @ unit(np.array(v))), 6) for i, v in vecs}
            rank = 1 + sum((s[i], -i) > (s[t], -t) for i in s if i != t)
            want[r] = rank if rank <= 50 else None
    for kw in ({}, {"row_block": 7, "item_block": 11}, {"row_block": 1000, "item_block": 1}):
        got = {r["row_id"]: r["rank"] for r in ni.evaluate_from_histories(df, items, **kw).collect()}
        assert got == want


def test_encoder_pooling(spark):
    with pytest.raises(ValueError):
        em.HashEncoder(pooling="cls")
    texts = ["a b a", "", None, "ab.c d  d", "x " * 500]
    total, mean = em.HashEncoder(pooling="sum")(texts), em.HashEncoder()(texts)
    assert np.allclose(mean[0] * 3, total[0]) and np.allclose(mean[4] * 500, total[4]) and not mean[1:3].any()
    assert np.allclose(np.vstack([em.HashEncoder()([t]) for t in texts]), mean)


def test_next_item_passes_and_component_slices(spark):
    """Several passes over the items and user vectors put together from components; every group in a partition of its own."""
    from recsift.operators import nextitem as ni

    rng = np.random.default_rng(8)
    vecs = [(f"i{i}", rng.normal(size=5).tolist()) for i in range(300)]
    items = spark.createDataFrame(vecs, "item_id string, vec array<double>")
    rows = [(r, [f"i{x}" for x in rng.integers(0, 310, 4)], f"i{rng.integers(0, 300)}") for r in range(200)]
    df = spark.createDataFrame(rows, "row_id long, history array<string>, target string")
    table = {i: np.array(v) / np.linalg.norm(v) for i, v in vecs}
    raw, want = dict(vecs), {}
    for r, h, t in rows:
        known = [raw[x] for x in h if x in raw]
        u = np.mean(known, axis=0)
        s = {i: round(float(u / np.linalg.norm(u) @ v), 6) for i, v in table.items()}
        rank = 1 + sum(s[i] > s[t] or (s[i] == s[t] and i < t) for i in s if i != t)
        want[r] = rank if rank <= 50 else None
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for kw in ({"row_block": 16, "item_block": 40}, {"pass_bytes": 9000, "means_bytes": 300 * 120}):
            assert {r["row_id"]: r["rank"] for r in ni.evaluate_from_histories(df, items, **kw).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_dense_grid_blocks_meet_in_any_partition(spark):
    rng = np.random.default_rng(9)
    q = _vecs(spark, [(i, rng.normal(size=4).tolist()) for i in range(60)], "qid")
    items = _vecs(spark, [(i, rng.normal(size=4).tolist()) for i in range(200)], "item_id")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        want = {(r.qid, r.item_id) for r in dn.dense_rank(q, items, 5).collect()}
        got = {(r.qid, r.item_id) for r in dn.dense_rank(q, items, 5, strategy="grid", query_block=9, item_block=17).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(want) == 300 and got == want


def test_bm25_index_is_inverted_where_documents_are_read(spark):
    """no shuffle or sort of (document, term) rows; postings equal a plain count."""
    texts = ["b a b", None, "", "a c", "b", "c c c d", "the", "d a"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    blocks = lx.posting_blocks(docs, "doc_id", "text", block_docs=3)
    plan = blocks._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in plan and "Sort" not in plan and "Aggregate" not in plan
    got = {}
    for r in blocks.collect():
        assert 0 < r.n == len(r.docs) <= 3 and r.sum_tf == sum(d.tf for d in r.docs)
        assert r.max_tf == max(d.tf for d in r.docs) and r.min_dl == min(d.dl for d in r.docs)
        for d in r.docs:
            assert (r.term, d.doc_id) not in got
            got[r.term, d.doc_id] = (d.tf, d.dl)
    want = {}
    for i, t in enumerate(texts):
        toks = [w for w in (t or "").split() if w not in set(lx.ENGLISH)]
        want |= {(w, i): (toks.count(w), len(toks)) for w in toks}
    assert got == want
