"""The stored cell index: life cycle, recall, pruning."""

import numpy as np
from pyspark.sql import functions as F

from recsift.operators import dense as dn
from recsift.operators import vectorstore as vs


def test_life_cycle(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=8)).tolist(), f"sentence {i}") for i in range(600)] + [(900, None, "none")]
    items = spark.createDataFrame(rows, "item_id long, vec array<double>, sentence string")
    queries = items.filter("item_id % 10 = 0 and vec is not null").select(F.col("item_id").alias("qid"), "vec")
    path = str(tmp_path / "index")
    first = F.pmod(F.xxhash64("item_id"), F.lit(2)) == 0
    built = vs.build_store(items.filter(first), path, keep=["sentence"], n_cells=12, queries=queries)
    vs.append(built, items.filter(~first))
    store = vs.open_store(spark, path)
    assert store.n_probe == built.n_probe and store.rows.count() == 600 and np.allclose(store.centroids, built.centroids)
    store = vs.measure(store, queries)
    exact = {(r["qid"], r["item_id"]): r["score"] for r in dn.dense_rank(queries, items, 10).collect()}
    every = {(r["qid"], r["item_id"]): (r["score"], r["sentence"]) for r in vs.search(store, queries, 10, n_probe=12).collect()}
    assert every == {k: (v, f"sentence {k[1]}") for k, v in exact.items()}
    assert store.n_probe < 12
    found = {(r["qid"], r["item_id"]) for r in vs.search(store, queries, 10).collect()}
    assert len(found & set(exact)) >= 0.9 * len(exact)
    high = {(r["qid"], r["item_id"]) for r in vs.search(store, queries, 10, threshold=0.9, n_probe=12).collect()}
    assert high == {k for k, v in exact.items() if v >= 0.9}


def test_searching_reads_probed_cells_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "item_id long, vec array<double>")
    store = vs.build_store(items, str(tmp_path / "i"), n_cells=10)
    rows = vs.probed_rows(store, [3, 4])
    assert "PartitionFilters: [cell#" in rows._jdf.queryExecution().executedPlan().toString()
    files = {r["f"] for r in rows.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files and all("cell=3" in f or "cell=4" in f for f in files)
    assert vs.search(store, spark.createDataFrame([], "qid long, vec array<double>"), 5).count() == 0
