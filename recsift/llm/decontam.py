"""Benchmark decontamination by a hash set of test n-grams (DataFrame functions only).

The normalised ``n``-word windows of all benchmark items form a table keyed by a
64-bit hash. It is broadcast when its counted size is small and joined by shuffle
otherwise. The training texts are scanned window by window (one generator over each
text, no shuffle of texts), hashing the window's words where they stand; a hash match is verified by comparing the window's text
in the join condition. Only verified hits are grouped per document.

Defined cases: null or empty texts have no words and are never hit; an item with
fewer than ``n`` words (but not none) is one window; an item with a null id still marks words as hit but is not counted
as an item; rows with equal (doc_id, text) are one document in :func:`scan` and are
all kept or all removed by :func:`remove_documents`; an empty benchmark hits nothing;
other columns are ignored by :func:`scan` and passed through by the removers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words

# the window table is broadcast up to this many rows (about 100 bytes each)
BROADCAST_WINDOWS = 400_000


def _windows(words: Column, length: int) -> Column:
    """Array of (pos, len, gram) for all windows of ``length`` words."""
    last = F.size(words) - F.lit(length)
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("pos"), F.lit(length).alias("len"), F.array_join(F.slice(words, i + 1, length), " ").alias("gram")))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<struct<pos:int,len:int,gram:string>>"))


def _hash(words: Column, pos: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, pos + i) for i in range(length)])


def _by_length(lengths: list[int], of: str, value) -> Column:
    return F.coalesce(*[F.when(F.col(of) == k, value(k)) for k in lengths], F.lit(None).cast("long"))


def item_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``i_gram, i_len, i_items``: one row per distinct window."""
    x = items.select(F.col(id_col).alias("item_id"), alnum_words(F.col(text_col)).alias("words"))
    k = F.size("words")
    whole = F.array(F.struct(F.lit(0).alias("pos"), k.alias("len"), F.array_join("words", " ").alias("gram")))
    grams = F.when(k == 0, F.array().cast("array<struct<pos:int,len:int,gram:string>>")) \
        .when(k < n, whole).otherwise(_windows(F.col("words"), n))
    x = x.select("item_id", F.explode(grams).alias("g"))
    return (x.groupBy(F.col("g.gram").alias("i_gram"), F.col("g.len").alias("i_len"))
            .agg(F.collect_set("item_id").alias("i_items")))


def scan(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document ``doc_id, text_hash, n_words, hits`` with ``hits`` the verified
    windows as array of (pos, len, items), in no fixed order."""
    windows = item_windows(items, n, item_id, item_text)
    known = windows.groupBy("i_len").count().collect()  # at most n rows
    lengths, total = sorted(r["i_len"] for r in known), sum(r["count"] for r in known)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       alnum_words(F.col(text_col)).alias("words"))
    # the row of the first word (null without words) keeps documents without windows
    rows = base.select("doc_id", "text_hash", "words", F.size("words").cast("long").alias("n_words"),
                       F.posexplode_outer("words").alias("pos", "word"))
    rows = rows.withColumn("len", F.explode(F.array(*map(F.lit, lengths))) if len(lengths) > 1 else F.lit(max(lengths, default=0)))
    # words are hashed where they stand; a window's text is put together only where its hash is an item window's
    rows = rows.withColumn("h", _by_length(lengths, "len", lambda k: F.when(
        F.col("pos") + k <= F.col("n_words"), _hash(F.col("words"), F.col("pos"), k))))
    gram = F.array_join(F.slice("words", F.col("pos") + 1, F.col("len")), " ")
    windows = windows.withColumn("i_words", F.split("i_gram", " ")).withColumn(
        "i_h", _by_length(lengths, "i_len", lambda k: _hash(F.col("i_words"), F.lit(0), k))).drop("i_words")
    if total <= BROADCAST_WINDOWS:
        # an equation would be a join key, whose text is made for every window
        side, same = F.broadcast(windows), F.startswith(gram, F.col("i_gram")) & F.startswith(F.col("i_gram"), gram)
    else:
        side, rows = windows, rows.withColumn("gram", gram).drop("words", "word")
        same = F.col("gram") == F.col("i_gram")
    found = rows.join(side, (F.col("h") == F.col("i_h")) & same, "left") \
        .filter(F.col("i_h").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    hit = F.when(F.col("i_h").isNotNull(), F.struct("pos", "len", F.col("i_items").alias("items")))
    return found.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"),
                                                    F.collect_list(hit).alias("hits"))


def digest(scanned: DataFrame) -> DataFrame:
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))
    ids = F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))
    names = F.array_sort(F.transform(ids, lambda i: i.cast("string")))
    return scanned.select(
        "doc_id", "n_words", F.size(covered).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    bad = scan(docs, items, n, id_col, text_col).filter(F.size("hits") > 0) \
        .select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad_id"]) &
                     (F.xxhash64(docs[text_col]) == bad["__bad_hash"]), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words cut out of ``text`` (the separators around them
    stay); a null text stays null."""
    hit = scan(docs, items, n, id_col, text_col).filter(F.size("hits") > 0)
    hit = hit.select(F.col("doc_id").alias("__hit_id"), F.col("text_hash").alias("__hit_hash"),
                     F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(
                         h["pos"], h["pos"] + h["len"] - 1)))).alias("__cut"))
    x = docs.join(hit, docs[id_col].eqNullSafe(hit["__hit_id"]) &
                  (F.xxhash64(docs[text_col]) == hit["__hit_hash"]), "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before lower-casing
    words, gaps = F.regexp_extract_all(text_col, F.lit(f"({word})"), 1), F.split(text_col, word, -1)
    kept = F.transform(words, lambda w, i: F.when(F.array_contains(F.col("__cut"), i), F.lit("")).otherwise(w))
    text = F.array_join(F.transform(F.arrays_zip(gaps.alias("a"), kept.alias("b")),
                                    lambda p: F.concat(p["a"], F.coalesce(p["b"], F.lit("")))), "")
    return x.withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(text)).select(docs.columns)
