"""Results that must not depend on layout, file formats with quotes, null keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsift.operators import dense as dn
from recsift.operators import interactions as ops
from recsift.operators import metrics as mt
from recsift.operators import sequences as sq
from recsift.operators.textmatch import first_containing
from recsift.sources import readers, writers


def test_rounded_ties_and_zero_queries_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base + (1e-8 * (i % 7)) * rng.normal(size=8)).tolist()) for i in range(60)]
    rows += [(100 + i, rng.normal(size=8).tolist()) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id long, vec array<double>")
    queries = spark.createDataFrame([(1, base.tolist()), (2, [0.0] * 8), (3, rng.normal(size=8).tolist())], "qid long, vec array<double>")
    want = None
    for parts in (1, 3, 16):
        for kw in ({}, {"strategy": "grid", "query_block": 2, "item_block": 7}):
            spread = items.repartition(parts, F.rand(parts))
            got = sorted((r["qid"], r["rank"], r["item_id"]) for r in dn.dense_rank(queries, spread, 5, **kw).collect())
            want = want or got
            assert got == want
    assert [i for q, _, i in want if q == 2] == [0, 1, 2, 3, 4]     # a zero query ties with everything
    cand = dn.dense_candidates(queries, items.coalesce(1), 5, strategy="broadcast")
    assert cand.groupBy("qid").count().agg(F.max("count")).first()[0] <= 5 * 8
    with pytest.raises(ValueError):
        dn.similarity_table(queries, items, "qid", "vec", "item_id", "vec")


def test_several_pattern_sets_in_one_session(spark):
    docs = spark.createDataFrame([(i, f"start {i} some words of document number {i} end x{i}") for i in range(20)], "doc_id long, text string")
    for lo in (0, 5, 10):
        pats = spark.createDataFrame([(i, f"words of document number {i} e") for i in range(lo, lo + 3)] + [(99, f"x{lo}")],
                                     "pid long, text string")
        got = {r["pid"]: r["target"] for r in first_containing(pats, docs, "pid", "text", "doc_id", "text").collect()}
        assert got == {lo: lo, lo + 1: lo + 1, lo + 2: lo + 2, 99: lo}


def test_quotes_commas_and_line_breaks(spark, tmp_path):
    text = 'tv 5", "wall", a\\b'
    q = spark.createDataFrame([(0, text + "\nnext", "a")], "qid long, query string, item_id string")
    path = writers.write_queries_csv(q, str(tmp_path / "q"))
    assert readers.read_queries(spark, path).first()[:3] == (0, text + "\nnext", "a")
    pairs = spark.createDataFrame([(text, '"')], "review string, meta string")
    path = writers.write_pairs_tsv(pairs, str(tmp_path / "p.tsv"))
    assert tuple(readers.read_text_pairs(spark, path, ("review", "meta")).first()) == (text, '"')
    import glob
    import pandas as pd
    whole = pd.concat(pd.read_csv(part, sep="\t") for part in glob.glob(f"{path}/*.csv"))
    assert whole.values.tolist() == [[text, '"']]


def test_review_times(spark, tmp_path):
    f = tmp_path / "r.jsonl"
    line = '{"user_id": "u", "parent_asin": "a", "rating": 4, "sortTimestamp": %s}\n'
    f.write_text("".join(line % x for x in ("-1.5", "1.5", '"12"', '"1.5"', "null", "7")) + "\n{broken\n")
    good, rejects = readers.read_reviews_jsonl(spark, str(f))
    assert sorted(r["timestamp"] for r in good.collect()) == [-1, 1, 7, 12] and rejects.count() == 3


def test_vector_parts_keep_ids_and_rewrites_leave_nothing(spark, tmp_path):
    df = spark.range(50).select("id", F.array(*[(F.col("id") * 4 + i).cast("float") for i in range(4)]).alias("vec"))
    out = str(tmp_path / "v")
    writers.write_vectors_f32(df, out, parts=13)
    writers.write_vectors_f32(df, out, parts=3)
    got = readers.read_vectors_f32(spark, out, 4).orderBy("id").collect()
    assert [(r["id"], list(r["vec"])) for r in got] == [(i, [4.0 * i + j for j in range(4)]) for i in range(50)]


def test_core_with_null_keys_and_round_limit(spark):
    rows = [(u, i) for u in range(4) for i in range(4)] + [(None, 0), (None, 1), (0, None), (1, None), (9, 3)]
    ix = spark.createDataFrame(rows, "user_id long, parent_asin long")
    res = ops.k_core(ix, 3)
    assert res.converged and res.edges.count() == 16
    assert not ops.k_core(ix, 3, max_rounds=0).converged


def test_history_of_a_null_user_over_blocks(spark):
    ix = spark.createDataFrame([(None, i, i) for i in range(12)], "user_id long, parent_asin long, timestamp long")
    ranked, longest = ops.chronological_rank_stats(ix)
    got = ops.with_history(ranked, block_rows=4, max_user_rows=longest).orderBy("timestamp").collect()
    assert [len(r["history"]) for r in got] == list(range(12))


def test_per_category_core_equals_single_runs(spark):
    rows = [(u, i, c) for c in ("a", "b") for u in range(5) for i in range(6) if (u * 7 + i * 3 + len(c) + ord(c)) % 4]
    ix = spark.createDataFrame(rows, "user_id long, parent_asin long, category string")
    got = {tuple(r) for r in ops.per_category(ix, "category", lambda x, u, i: ops.k_core(x, 4, 4, u, i).edges)
           .select("user_id", "parent_asin", "category").collect()}
    want = set()
    for c in ("a", "b"):
        want |= {(r["user_id"], r["parent_asin"], c) for r in ops.k_core(ix.filter(F.col("category") == c), 4).edges.collect()}
    assert got == want


def test_process_histories(spark):
    items = spark.createDataFrame([(i,) for i in (1, 2, 3, 5)], "parent_asin long")
    rows = spark.createDataFrame([("u", 3, [1, 9, 2, 1]), ("u", 4, [1]), ("v", 5, [8]), ("w", 5, []), ("x", 2, [1, 2, 3, 5])],
                                 "user_id string, parent_asin long, history array<long>")
    got = {r["user_id"]: r["history"] for r in sq.process_histories(rows, items, 3).collect()}
    assert got == {"u": [1, 2, 1], "x": [2, 3, 5]}


def test_hard_negative_logit(spark):
    rows = [(i, [1.0, float(i)], [1.0, i + 0.5], [float(i), 1.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "i long, a array<double>, b array<double>, h array<double>")
    loss = lambda w: mt.in_batch_contrastive(df, ["i"], "a", "b", 4, hard_negative="h", hard_weight=w).first()["loss"]
    assert loss(-5.0) < loss(0.0) < loss(5.0)


def test_category_files_and_later_rows(spark, tmp_path):
    from recsift.operators.pairs import build_pretrain_pairs

    cats = ["Zoo and Pets", "All Beauty"]       # the list's order counts, not the names'
    rows = [(1, "Zoo and Pets", "first listing of item one " * 2), (1, "All Beauty", "later listing of item one " * 2),
            (2, "Zoo and Pets", "only listing of item two " * 2)]
    df = spark.createDataFrame(rows, "parent_asin long, category string, title string").withColumns({
        "features": F.array().cast("array<string>"), "description": F.array().cast("array<string>")})
    folder = writers.write_categories(df, str(tmp_path / "c"), cats)
    got = readers.read_categories(spark, folder, cats, "parent_asin long, title string, features array<string>, description array<string>")
    assert {(r["parent_asin"], r["category"], r["category_no"]) for r in got.collect()} == {(1, cats[0], 0), (1, cats[1], 1), (2, cats[0], 0)}
    reviews = spark.createDataFrame([("u", i, i, "t", "a review that is long enough to be kept") for i in (1, 2)],
                                    "user_id string, parent_asin long, timestamp long, title string, text string")
    pairs = build_pretrain_pairs(reviews, got.drop("category"), 100, 1, item_order="category_no").collect()
    assert {r["parent_asin"]: r["meta"].split()[0] for r in pairs} == {1: "later", 2: "only"}
    with pytest.raises(ValueError):
        readers.read_categories(spark, folder, ["a b", "a_b"], "x int")


def test_pool_takes_its_category_text(spark):
    from recsift.operators.testsets import _pool

    pos = spark.createDataFrame([(1, "a"), (2, "a")], "item_id long, category string")
    text = spark.createDataFrame([(1, "a", "one a"), (1, "b", "one b"), (3, "a", "three")], "item_id long, category string, metadata string")
    assert [tuple(r) for r in _pool(pos, pos.limit(0), text).collect()] == [(1, "a", "one a")]


def test_vector_set_survives_a_crash_between_steps(spark, tmp_path):
    import os

    df = spark.range(20).select("id", F.array(F.col("id").cast("float")).alias("vec"))
    out = str(tmp_path / "v")
    writers.write_vectors_f32(df, out, parts=4)
    open(os.path.join(out, "_new-00000.f32"), "wb").write(b"junk")      # left by a write that died while moving
    assert readers.read_vectors_f32(spark, out, 1).count() == 20
    writers.write_vectors_f32(df, out, parts=2)
    assert sorted(f for f in os.listdir(out) if not f.startswith(".")) == ["part-00000.f32", "part-00001.f32"]
