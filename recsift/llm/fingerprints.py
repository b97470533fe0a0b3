"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A text is the weighted set of its words (white-space separated), the weight being
the word's count. For each of ``SAMPLES`` draws and each word with weight w, the word's
own random numbers r, c ~ Gamma(2, 1) and b ~ U(0, 1) give

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r

and the draw's sample is the (word, t) with the smallest a. Two texts share a draw's
sample with probability sum(min weights) / sum(max weights), the generalised Jaccard
similarity. r, ln c and b come from one 64-bit hash of (word, draw): the gammas through
quantile tables computed here, so a draw costs one hash and two look-ups.

Words are counted inside their text's row and sampled inside its partition; no word ever
crosses a shuffle.

Defined cases: null text is empty; an empty text has an empty signature, whose
likeness is 1 to another empty one and 0 to anything else; rows with equal (doc_id,
text) are one document; a null doc_id comes first in the order; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import global_row_number
from .common import materialise

SAMPLES = 32
DRAWS_PER_ROW = 4     # draws in one expression: more would outgrow what the JVM compiles
TABLE_BITS = 12
ID_BITS = 29          # bits of a sample's identity kept below the ordered ln a


@lru_cache
def gamma2_quantiles(bits: int = TABLE_BITS) -> tuple[float, ...]:
    """Quantiles of Gamma(2, 1) at the mid-points of 2**bits equal steps (the
    distribution function is 1 - (1 + x) exp(-x), inverted by Newton steps)."""
    out, x = [], 0.02
    for i in range(1 << bits):
        u = (i + 0.5) / (1 << bits)
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - u) / (x * math.exp(-x))
            x = max(x - step, x / 4)
            if abs(step) < 1e-13:
                break
        out.append(x)
    return tuple(out)


def _gamma_tables(spark: SparkSession) -> tuple[Column, Column]:
    """Arrays of the quantiles and of their logarithms, each evaluated once."""
    rows = spark.createDataFrame([(i, x, math.log(x)) for i, x in enumerate(gamma2_quantiles())],
                                 "i int, r double, c double")

    def one(name: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("i", name)))
        return rows.agg(F.transform(ordered, lambda z: z[name]).alias("a")).scalar()
    return one("r"), one("c")


def sample_columns(tables: tuple[Column, Column], term: Column, ln_weight: Column, first: Column,
                   draws: int = DRAWS_PER_ROW) -> list[Column]:
    """One long for each of the draws ``first, first + 1, ...``: ln a (fixed point)
    above the identity bits of (word, t); the smallest long of a text is its sample."""
    mask = (1 << TABLE_BITS) - 1
    out = []
    for k in range(draws):
        h = F.xxhash64(term, first + F.lit(k))
        r = F.get(tables[0], h.bitwiseAND(mask).cast("int"))
        ln_c = F.get(tables[1], F.shiftright(h, TABLE_BITS).bitwiseAND(mask).cast("int"))
        b = F.shiftright(h, 2 * TABLE_BITS).bitwiseAND((1 << 20) - 1) / F.lit(float(1 << 20))
        t = F.floor(ln_weight / r + b)
        ln_a = ln_c - r * (t - b + 1)   # in (-64, 8)
        ident = (F.shiftrightunsigned(h, 30) + t * F.lit(2654435761)).bitwiseAND((1 << ID_BITS) - 1)
        out.append((F.floor((ln_a + 64.0) * F.lit(float(1 << 26))) * F.lit(1 << ID_BITS) + ident).alias(f"s{k}"))
    return out


def signatures(texts: DataFrame, keys: list[str], text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``keys`` + ``sig``: array of sample identities (empty for a text without words).
    ``keys`` must identify a text. ``samples`` is a multiple of ``DRAWS_PER_ROW``."""
    words = F.filter(F.split(F.col(text_col), r"[\x09-\x0D\x20]+"), lambda w: w != "")
    # words go on as sorted 64-bit hashes; the places where the hash changes give the counts
    x = texts.select(*keys, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("__s"))
    x = x.select("*", F.when(F.size("__s") > 0, F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda i: (i == 0) | (
        F.get("__s", i) != F.get("__s", i - 1)))).otherwise(F.array().cast("array<int>")).alias("__at"))
    ends = lambda i: F.coalesce(F.get("__at", i + 1), F.size("__s"))
    counted = x.select(*keys, F.explode_outer(F.transform("__at", lambda p, i: F.struct(
        F.get("__s", p).alias("t"), (ends(i) - p).alias("n")))).alias("__w"))
    terms = counted.select(*keys, F.col("__w.t").alias("__t"), F.col("__w").isNull().alias("__none"),
                           F.log(F.col("__w.n").cast("double")).alias("__lw"),
                           F.explode(F.array(*[F.lit(k) for k in range(0, samples, DRAWS_PER_ROW)])).alias("__k"))
    drawn = terms.select(*keys, "__none", "__k", *sample_columns(
        _gamma_tables(texts.sparkSession), F.col("__t"), F.col("__lw"), F.col("__k")))
    draws = range(DRAWS_PER_ROW)
    best = drawn.groupBy(*keys, "__none", "__k").agg(*[F.min(f"s{k}").alias(f"s{k}") for k in draws])
    ids = F.array(*[F.col(f"s{k}").bitwiseAND((1 << ID_BITS) - 1) for k in draws])
    whole = best.groupBy(*keys, "__none").agg(F.array_sort(F.collect_list(F.struct("__k", ids.alias("ids")))).alias("g"))
    return whole.select(*keys, F.when(F.col("__none"), F.array().cast("array<bigint>")).otherwise(
        F.flatten(F.transform("g", lambda x: x["ids"]))).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of draws with the same sample."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")) \
        .otherwise(same / F.size(a))


def fingerprint_text(sig: Column) -> Column:
    """The signature as a string of 8 hex digits per draw."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def neighbours(texts: DataFrame) -> DataFrame:
    """``k1, k2, p1, p2, prev_chars``: each document's key, the key and length of the one
    before it in the order of (doc_id, text hash); before the first comes the last."""
    small = texts.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"))
    numbered = global_row_number(small, ["doc_id", "k2"], "rn", start=0)
    n = max(numbered.count(), 1)
    prev = numbered.select(F.pmod(F.col("rn") + 1, F.lit(n)).alias("rn"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("n_chars").alias("prev_chars"))
    return numbered.join(prev, "rn").select("k1", "k2", "p1", "p2", "prev_chars")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last half replaced by
    the head of the next document), with their likeness and that to the next text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), t.alias("text"), F.xxhash64(F.col(id_col)).alias("k1"),
                        F.xxhash64(t).alias("k2"))
    place = materialise(neighbours(texts.select("k1", "k2", "doc_id", F.length("text").cast("long").alias("n_chars"))),
                        "neighbours")
    # texts move once, to their key's partition; what a text lends moves to the one before
    own = texts.groupBy("k1", "k2").agg(F.first(F.struct("doc_id", "text")).alias("d")).join(place, ["k1", "k2"])
    lent = own.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"),
                      F.expr("substring(d.text, 1, int(floor(prev_chars / 2)))").alias("lent"))
    pair = own.join(lent, (own["k1"] == lent["h1"]) & (own["k2"] == lent["h2"]))
    edited = F.concat(F.expr("substring(d.text, 1, char_length(d.text) - int(floor(char_length(d.text) / 2)))"), "lent")
    pair = pair.select("k1", "k2", "p1", "p2", "d", edited.alias("edited"))
    about = pair.select("k1", "k2", "p1", "p2", "d.doc_id", F.length("d.text").cast("long").alias("n_chars"),
                        F.sha2("edited", 256).alias("edited_sha256"))
    sided = pair.select("k1", "k2", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("d.text").alias("t")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("v"))
    sig = signatures(sided.select("k1", "k2", "v.side", F.col("v.t").alias("text")), ["k1", "k2", "side"], "text", samples)
    both = about.join(sig.groupBy("k1", "k2").agg(
        F.max(F.when(F.col("side") == 0, F.col("sig"))).alias("sig"),
        F.max(F.when(F.col("side") == 1, F.col("sig"))).alias("edited_sig")), ["k1", "k2"])
    both = materialise(both, "fingerprints")  # read twice below
    following = both.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("sig").alias("next_sig"))
    y = both.join(following, ["k1", "k2"])
    return y.select("doc_id", "n_chars", "edited_sha256", "sig", "edited_sig",
                    likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                    likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def digest(x: DataFrame) -> DataFrame:
    return x.select("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("sig")).alias("fingerprint"),
                    fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"), "near_edited", "near_next")
