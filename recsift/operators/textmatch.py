"""Exact passage-in-document matching without a cross join.

A theta join ``contains(doc.text, passage)`` would pair every passage with every
document. A passage of three or more space-separated parts has whole parts inside, which any
document containing it holds too: its longest run of up to ``GRAM`` inner parts (most
characters, so most likely rare) is its key. While the counted keys are few, the documents' parts meet the longest part of each
key in a broadcast join right after the split, and the run around a hit is compared inside the row; nothing else leaves
the row. Beyond that, runs are compared as 64-bit hashes in a shuffled join. Passages of one or two parts have no inner part; their key is
their first ``CHARS`` characters (all, if fewer), met the same way by hashes. Candidate pairs are verified with
``contains`` on the whole texts, and the smallest document of each passage is kept. An empty
passage is in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4
CHARS = 8
BROADCAST_KEYS = 400_000


def _run_hashes(parts: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` consecutive elements of ``parts`` (a column of its own)."""
    places = F.when(F.size(parts) >= n, F.sequence(F.lit(0), F.size(parts) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(n), *[F.get(parts, i + j) for j in range(n)]))


def _meet_hashes(texts: DataFrame, keyed: DataFrame, pattern: str) -> DataFrame:
    """``_pid, _doc``: pairs that share a run. ``keyed``: _pid, _n, _run."""
    sizes = {r["_n"]: r["count"] for r in keyed.groupBy("_n").count().collect()}   # at most one row per run length
    if not sizes:
        return keyed.sparkSession.createDataFrame([], "_pid long, _doc long")
    key = F.coalesce(*[F.when(F.col("_n") == n, F.xxhash64(F.lit(n), *[F.get("_run", F.lit(j)) for j in range(n)])) for n in sizes])
    keys = keyed.select("_pid", key.alias("_key"))
    keys = F.broadcast(keys) if sum(sizes.values()) <= BROADCAST_KEYS else keys
    split = texts.select("_doc", F.split("_text", pattern, -1).alias("_e"))
    runs = F.concat(*[_run_hashes(F.col("_e"), n) for n in sorted(sizes)])
    # outer: the filter inferred for an inner explode would be pushed below the split, into the lambda
    return split.select("_doc", F.explode_outer(runs).alias("_key")).join(keys, "_key").select("_pid", "_doc").distinct()


def _meet_parts(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """``_pid, _doc``: pairs that share a run; ``keyed`` (_pid, _n, _run) is small."""
    sizes = F.transform("_run", lambda p, i: F.struct(F.length(p).alias("l"), (-i).alias("i"), p.alias("p")))
    keys = keyed.withColumn("_top", F.array_max(sizes)).select(
        "_pid", "_n", "_run", F.col("_top.p").alias("_part"), (-F.col("_top.i")).alias("_off"))
    split = texts.select("_doc", F.split("_text", " ", -1).alias("_e"))
    hits = split.select("_doc", "_e", F.posexplode_outer("_e").alias("_at", "_w")).join(F.broadcast(keys), F.col("_w") == F.col("_part"))
    start = F.col("_at") - F.col("_off")
    same = F.when(start >= 0, F.slice("_e", start + 1, F.col("_n")) == F.col("_run")).otherwise(F.lit(False))
    return hits.filter(same).select("_pid", "_doc").distinct()


def first_containing(patterns: DataFrame, docs: DataFrame, pid: str, ptext: str, did: str, dtext: str,
                     out: str = "target") -> DataFrame:
    """For each pattern row: the smallest ``did`` whose ``dtext`` contains the
    whole pattern text. Patterns without a match are dropped (inner-join
    semantics). ``pid`` and ``did`` must be integral."""
    pats = patterns.select(F.col(pid).cast("long").alias("_pid"), F.col(ptext).alias("_t")).filter(F.col("_t").isNotNull())
    parts = F.split(F.col("_t"), " ", -1)
    pats = pats.withColumn("_in", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
    texts = docs.select(F.col(did).cast("long").alias("_doc"), F.col(dtext).alias("_text"))
    # arrays are columns of their own: inside a lambda an expression is evaluated for every element
    inner = pats.filter(F.size("_in") > 0).withColumn("_n", F.least(F.size("_in"), F.lit(GRAM)))
    size = F.transform("_in", lambda p: F.length(p))
    inner = inner.withColumn("_len", size).withColumn("_at", F.array_max(F.transform(
        F.sequence(F.lit(0), F.size("_in") - F.col("_n")),
        lambda i: F.struct(F.aggregate(F.slice("_len", i + 1, F.col("_n")), F.lit(0), lambda a, x: a + x).alias("l"), (-i).alias("i"))))["i"])
    inner = inner.select("_pid", "_n", F.slice("_in", 1 - F.col("_at"), F.col("_n")).alias("_run"))
    few = inner.count() <= BROADCAST_KEYS
    short = pats.filter((F.size("_in") == 0) & (F.col("_t") != "")).withColumn("_n", F.least(F.length("_t"), F.lit(CHARS)))
    short = short.select("_pid", "_n", F.split(F.expr("substring(_t, 1, _n)"), "", -1).alias("_run"))
    pairs = (_meet_parts(texts, inner) if few else _meet_hashes(texts, inner, " ")).unionByName(_meet_hashes(texts, short, ""))
    found = pairs.join(texts, "_doc").join(pats.select("_pid", "_t"), "_pid").filter(F.contains("_text", "_t")).select("_pid", "_doc")
    everywhere = texts.filter(F.col("_text").isNotNull()).agg(F.min("_doc").alias("_doc")).filter(F.col("_doc").isNotNull())
    empty = pats.filter(F.col("_t") == "").select("_pid").join(F.broadcast(everywhere))   # one row
    best = found.unionByName(empty).groupBy("_pid").agg(F.min("_doc").alias(out))
    return patterns.join(best, patterns[pid].cast("long") == best["_pid"]).drop("_pid")
