"""BM25 lexical retrieval (A8, D13, J6, W6) over a stored, block-max inverted index.

*Index.* Blocks are ``BLOCK_DOCS`` documents that a task reads one after another. The task counts and inverts the
tokens of ``RUN_BLOCKS`` blocks at a time over Arrow, so neither texts nor counts are shuffled or sorted by Spark, and a posting row
holds one term's documents of one block with the largest term frequency and the shortest
length there. A term that is in every document is spread over all blocks, so no term is a hot
key. The index is written once, in runs sorted by term, and read by every query; terms
``(term, df, idf)`` and three corpus scalars come from its columns.

*Search.* A query's terms meet the blocks' summaries (not the postings): the sum of the largest contributions
of its terms bounds every score of a block. The blocks with the highest bounds are
scored first; their k-th score is a threshold that blocks with a smaller bound cannot
reach. Only the blocks left are scored, exactly. The top-k per query uses ``row_number() <= k``, which Spark plans
as a partial WindowGroupLimit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH
from ..functions.text import tokenize
from ..session import stored

BLOCK_DOCS = 64            # documents of a block
RUN_BLOCKS = 32            # blocks that a task inverts at a time
BROADCAST_ROWS = 500_000   # query terms, or blocks to score, that are broadcast


@dataclass
class BM25Index:
    blocks: DataFrame    # term, blk, n, max_tf, min_dl, sum_tf, docs (doc, tf, dl); stored once
    terms: DataFrame     # term, df, idf, idf_used (stored once)
    n_docs: int
    avgdl: float
    mean_idf: float
    doc: str

    @property
    def postings(self) -> DataFrame:
        return self.blocks.select("term", F.explode("docs").alias("_p")).select(
            F.col(f"_p.{self.doc}").alias(self.doc), "term", "_p.tf", "_p.dl")


def doc_tokens(docs: DataFrame, doc: str, text: str, stop_words=ENGLISH) -> DataFrame:
    return docs.select(doc, tokenize(text, stop_words).alias("_toks"))


def _inverted(batch: pa.RecordBatch, first: int, block_docs: int) -> pa.RecordBatch:
    """Posting rows, by term and block, of a batch of documents (doc, tokens, length), cut into blocks from number ``first`` on."""
    doc, lists, dl = batch.columns
    row, codes = pa.compute.list_parent_indices(lists).to_numpy(), pa.compute.list_flatten(lists).dictionary_encode()
    words = codes.dictionary
    rank = np.empty(len(words), np.int64)
    rank[pa.compute.sort_indices(words).to_numpy()] = np.arange(len(words))
    # one number a (term, document): by term, and by document within
    key, tf = np.unique(rank[codes.indices.to_numpy()] * batch.num_rows + row, return_counts=True)
    term, at = np.divmod(key, batch.num_rows)
    blk = at // block_docs
    starts = np.flatnonzero(np.r_[len(key) > 0, (term[1:] != term[:-1]) | (blk[1:] != blk[:-1])])
    length = dl.take(pa.array(at))
    docs = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(key)].astype(np.int32)), pa.StructArray.from_arrays(
        [doc.take(pa.array(at)), pa.array(tf, pa.int64()), length], names=[batch.schema.names[0], "tf", "dl"]))

    def over(f: np.ufunc, x: np.ndarray) -> np.ndarray:
        return f.reduceat(x, starts) if len(starts) else x[:0]

    return pa.RecordBatch.from_arrays(
        [words.take(pa.compute.sort_indices(words)).take(pa.array(term[starts])), pa.array(blk[starts] + first, pa.int64()),
         pa.array(np.diff(np.r_[starts, len(key)]), pa.int64()), pa.array(over(np.maximum, tf), pa.int64()),
         pa.array(over(np.minimum, length.to_numpy(zero_copy_only=False)).astype(np.int32), pa.int32()),
         pa.array(over(np.add, tf), pa.int64()), docs], names=["term", "blk", "n", "max_tf", "min_dl", "sum_tf", "docs"])


def posting_blocks(docs: DataFrame, doc: str, text: str, stop_words=ENGLISH, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``term, blk, n, max_tf, min_dl, sum_tf, docs``: a task inverts its documents ``RUN_BLOCKS`` blocks at a time; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nxt = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, RUN_BLOCKS * block_docs):
                part = batch.slice(start, RUN_BLOCKS * block_docs)
                yield _inverted(part, nxt, block_docs)
                nxt += -(-part.num_rows // block_docs)

    kind = docs.schema[doc].dataType.simpleString()
    return doc_tokens(docs, doc, text, stop_words).withColumn("_dl", F.size("_toks")).mapInArrow(
        run, f"term string, blk long, n long, max_tf long, min_dl int, sum_tf long, docs array<struct<`{doc}`:{kind},tf:bigint,dl:int>>")


def build_bm25(docs: DataFrame, doc: str = "doc_id", text: str = "text", stop_words=ENGLISH,
               eps: float = 0.25, block_docs: int = BLOCK_DOCS) -> BM25Index:
    """The stored index; idf = ln(N-df+.5) - ln(df+.5); a negative idf is replaced by
    eps × mean idf (mean over all terms)."""
    n_docs = docs.count()
    blocks = stored(posting_blocks(docs, doc, text, stop_words, block_docs))
    idf = (blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("sum_tf").alias("cf"))
           .withColumn("idf", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    idf = stored(idf)
    row = idf.agg(F.avg("idf").alias("mean"), F.sum("cf").alias("tokens")).first()
    mean_idf = float(row["mean"] or 0.0)
    avgdl = float(row["tokens"] or 0) / n_docs if n_docs else 0.0
    terms = idf.select("term", "df", "idf", F.when(F.col("idf") >= 0, F.col("idf")).otherwise(F.lit(eps * mean_idf)).alias("idf_used"))
    return BM25Index(blocks, terms, n_docs, avgdl, mean_idf, doc)


@dataclass(frozen=True)
class Weighting:
    """Length-normalised term frequency; ``length_norm='document'`` uses dl/avgdl (textbook),
    ``'corpus'`` N/avgdl for every document, as the reference does."""
    k1: float = 1.5
    b: float = 0.75
    length_norm: str = "document"

    def saturation(self, index: BM25Index, tf: Column, dl: Column) -> Column:
        avgdl = index.avgdl if index.avgdl > 0 else 1.0
        length = dl / F.lit(avgdl) if self.length_norm == "document" else F.lit(index.n_docs / avgdl)
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length))


def query_terms(index: BM25Index, queries: DataFrame, qid: str = "qid", text: str = "query", stop_words=ENGLISH) -> DataFrame:
    """``qid, term, weight``; a repeated query term counts each time."""
    qt = (queries.select(qid, F.explode(tokenize(text, stop_words)).alias("term"))
          .groupBy(qid, "term").agg(F.count(F.lit(1)).alias("qtf")))
    return qt.join(index.terms.select("term", "idf_used"), "term").select(qid, "term", (F.col("qtf") * F.col("idf_used")).alias("weight"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table whose counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _scores(index: BM25Index, hits: DataFrame, qid: str, how: Weighting) -> DataFrame:
    """Scores of the documents of posting rows joined with query terms (qid, weight, docs)."""
    part = hits.select(qid, "weight", F.explode("docs").alias("_p")).select(
        qid, F.col(f"_p.{index.doc}").alias(index.doc),
        (F.col("weight") * how.saturation(index, F.col("_p.tf"), F.col("_p.dl"))).alias("part"))
    return part.groupBy(qid, index.doc).agg(F.sum("part").alias("score"))


def bm25_scores(index: BM25Index, queries: DataFrame, qid: str = "qid", text: str = "query", stop_words=ENGLISH,
                k1: float = 1.5, b: float = 0.75, length_norm: str = "document") -> DataFrame:
    """Score of every (query, document) sharing at least one term, without pruning."""
    qt = query_terms(index, queries, qid, text, stop_words)
    return _scores(index, index.blocks.join(qt, "term"), qid, Weighting(k1, b, length_norm))


def block_bounds(index: BM25Index, qt: DataFrame, qid: str, how: Weighting) -> DataFrame:
    """``qid, blk, bound``: the most a document of the block can score, from the summaries only.
    A term of negative weight can be missing from the best document, so it adds nothing."""
    best = F.col("weight") * how.saturation(index, F.col("max_tf"), F.col("min_dl"))
    return index.blocks.select("term", "blk", "max_tf", "min_dl").join(qt, "term").groupBy(qid, "blk").agg(
        F.sum(F.greatest(best, F.lit(0.0))).alias("bound"))


def live_blocks(index: BM25Index, qt: DataFrame, k: int, qid: str = "qid", how: Weighting = Weighting()) -> DataFrame:
    """``qid, blk``: the blocks that can hold one of the query's first ``k`` documents."""
    bounds = stored(block_bounds(index, qt, qid, how))
    w = Window.partitionBy(qid).orderBy(F.desc("bound"), "blk")
    seeds = bounds.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(4, k // 8)).select(qid, "blk")
    first = top_k(score_blocks(index, qt, stored(seeds), qid, how), qid, index.doc, k)
    least = first.filter(F.col("rank") == k).select(F.col(qid).alias("_q"), F.col("score").alias("least"))
    # scores are ranked by six digits; the slack also covers the order of summation
    enough = F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) + 2e-6 >= F.col("least"))
    return stored(bounds.join(least, F.col(qid) == F.col("_q"), "left").filter(enough).select(qid, "blk"))


def score_blocks(index: BM25Index, qt: DataFrame, live: DataFrame, qid: str = "qid", how: Weighting = Weighting()) -> DataFrame:
    """Exact scores of the documents in the ``live`` (stored) blocks of each query."""
    return _scores(index, index.blocks.select("term", "blk", "docs").join(qt, "term").join(_small(live), [qid, "blk"]), qid, how)


def bm25_search(index: BM25Index, queries: DataFrame, k: int = 100, qid: str = "qid", text: str = "query", k1: float = 1.5,
                b: float = 0.75, length_norm: str = "document", stop_words=ENGLISH) -> DataFrame:
    """Top-k documents per query (only documents that match a term), block-max pruned."""
    how = Weighting(k1, b, length_norm)
    qt = _small(stored(query_terms(index, queries, qid, text, stop_words)))
    return top_k(score_blocks(index, qt, live_blocks(index, qt, k, qid, how), qid, how), qid, index.doc, k)


def top_k(scores: DataFrame, group: str, item: str, k: int, score: str = "score", digits: int = 6,
          rank: str = "rank") -> DataFrame:
    """The k best rows per group by (rounded score desc, item asc)."""
    s = scores.withColumn(score, F.round(score, digits))
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item).asc())
    # filter on the bare row_number so Catalyst infers a (partial) WindowGroupLimit
    out = s.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
    return out.withColumn(rank, F.col(rank).cast("bigint"))


def bm25_rank(docs: DataFrame, queries: DataFrame, k: int = 100, doc: str = "doc_id", text: str = "text",
              qid: str = "qid", qtext: str = "query", k1: float = 1.5, b: float = 0.75, eps: float = 0.25,
              length_norm: str = "document", stop_words=ENGLISH) -> DataFrame:
    """D13 in one call: build the index and search it."""
    return bm25_search(build_bm25(docs, doc, text, stop_words, eps), queries, k, qid, qtext, k1, b, length_norm, stop_words)
