"""Licence scan by a positional rare-token index (DataFrame functions only).

1. Document frequencies of the licence vocabulary over all texts give each word's IDF.
2. The index holds, for every base phrase and notice template, the postings
   (word, template, position) of its rarest words (highest IDF; one word for a phrase).
3. A text's occurrences of index words are looked up; a posting at template position
   p met at word i says that the template starts at i - p. The starts on which all of a
   template's rare words agree are its candidates (postings intersected by relative position).
4. A candidate is verified: a base phrase word by word; a template by its mandatory key
   phrases at their places and by the share of its words found in place.

The vocabulary, index and templates are fixed lists of bounded size and travel as
literals; texts are never shuffled.

Defined cases: null and empty texts have no words, no labels ('') and score 0; the
result has one row per input row, repeated rows and null ids included; an empty table
gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words
from .fixedvalues import BASE_PHRASES, LICENCE_TEMPLATES

RARE_WORDS = 2       # postings that have to agree on a template's start
MIN_COVERAGE = 0.6   # share of a template's words found in place


def patterns() -> list[dict]:
    """Base phrases, then templates: label, words and the places of mandatory words."""
    out = [{"base": True, "label": lab, "words": p.split(" "), "must": list(range(len(p.split(" "))))}
           for p, lab in BASE_PHRASES.items()]
    for label, text, phrases in LICENCE_TEMPLATES:
        words = text.split(" ")
        must = []
        for phrase in phrases:
            ph = phrase.split(" ")
            at = next(i for i in range(len(words)) if words[i:i + len(ph)] == ph)
            must += range(at, at + len(ph))
        out.append({"base": False, "label": label, "words": words, "must": must})
    return out


def vocabulary_idf(docs: DataFrame, words_col: str = "words") -> dict[str, float]:
    """IDF of every licence word over all rows (one small partial aggregate)."""
    vocab = sorted({w for p in patterns() for w in p["words"]})
    seen = F.array_distinct(F.filter(words_col, lambda w: w.isin(vocab)))
    # the extra entry counts the rows themselves
    counts = dict(docs.select(F.explode(F.concat(F.array(F.lit("")), seen)).alias("w")).groupBy("w").count().collect())
    n = counts.get("", 0)
    return {w: math.log((1 + n) / (1 + counts.get(w, 0))) for w in vocab}


def build_index(idf: dict[str, float]) -> list[tuple[str, int, int, int]]:
    """Postings (word, pattern, position, votes needed) of each pattern's rarest words."""
    out = []
    for k, p in enumerate(patterns()):
        # anchors are mandatory words, so a verified place always has all its votes
        order = sorted(set(p["must"]), key=lambda i: (-idf[p["words"][i]], i))
        picked = order[:1 if p["base"] else RARE_WORDS]
        out += [(p["words"][i], k, i, len(picked)) for i in picked]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_words, places`` with ``places`` = array of verified
    (pattern, base, label, start, coverage)."""
    base = docs.select(F.col(id_col).alias("doc_id"), alnum_words(F.col(text_col)).alias("words"))
    index = build_index(vocabulary_idf(base))
    anchors = sorted({w for w, *_ in index})
    pats = patterns()
    postings = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k"), F.lit(i).alias("i"),
                                  F.lit(need).alias("need")) for w, k, i, need in index])
    table = F.array(*[F.struct(F.lit(p["base"]).alias("base"), F.lit(p["label"]).alias("label"),
                               F.array(*[F.lit(w) for w in p["words"]]).alias("words"),
                               F.array(*[F.lit(i) for i in p["must"]]).alias("must")) for p in pats])
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchors), F.struct(w.alias("w"), i.alias("i")))),
                    lambda x: x.isNotNull())
    x = base.withColumn("hits", hits)
    votes = F.flatten(F.transform("hits", lambda h: F.transform(
        F.filter(postings, lambda p: p["w"] == h["w"]),
        lambda p: F.struct(p["k"].alias("k"), (h["i"] - p["i"]).alias("start"), p["need"].alias("need")))))
    # explode only rows with a vote: the postings are intersected by (pattern, start) inside the row
    sorted_votes = F.array_sort(votes)
    runs = F.filter(F.transform(F.col("votes"), lambda v, j: F.struct(
        v["k"].alias("k"), v["start"].alias("start"),
        ((j + v["need"] <= F.size("votes")) & F.coalesce(F.get("votes", j + v["need"] - 1) == v, F.lit(False)) &
         ((j == 0) | F.coalesce(F.get("votes", j - 1) != v, F.lit(True)))).alias("ok"))), lambda r: r["ok"])
    x = x.withColumn("votes", F.when(F.size("hits") > 0, sorted_votes)
                     .otherwise(F.array().cast("array<struct<k:int,start:int,need:int>>")))
    x = x.withColumn("runs", runs)

    def verify(r: Column) -> Column:
        p = F.get(table, r["k"])
        at = lambda i: F.coalesce(F.when(r["start"] + i >= 0, F.get(F.col("words"), r["start"] + i)) == F.get(p["words"], i), F.lit(False))
        share = F.size(F.filter(F.sequence(F.lit(0), F.size(p["words"]) - 1), at)) / F.size(p["words"])
        return F.struct(r["k"].alias("pattern"), p["base"].alias("base"), p["label"].alias("label"),
                        r["start"].alias("start"), share.alias("coverage"), F.forall(p["must"], at).alias("keys"))
    places = F.filter(F.transform("runs", verify), lambda v: v["keys"] & (v["coverage"] >= MIN_COVERAGE))
    none = F.array().cast("array<struct<pattern:int,base:boolean,label:string,start:int,coverage:double,keys:boolean>>")
    return x.select("doc_id", F.size("words").cast("long").alias("n_words"),
                    F.when(F.size("runs") > 0, places).otherwise(none).alias("places"))


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    names = lambda arr: F.array_join(F.array_sort(F.array_distinct(F.transform(arr, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"))
