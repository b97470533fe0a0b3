"""Language identification with language-bitmask n-gram filters.

Learning: character n-grams of the words of all training texts are counted by language.
An n-gram belongs to a language when its relative frequency there reaches ``FLOOR`` times
its highest one in any language (so a stray foreign passage sets no bits), and ``RARE`` of all
n-grams of the language (so the noise of a large corpus sets none, and a language has at most
``1 / RARE`` of them). The sets of all languages go into one bit-sliced Bloom filter: ``slots`` words whose bit ``b`` belongs to
language ``b``; an n-gram sets its mask in ``HASHES`` slots. There are at least ``SLOTS_PER_GRAM``
slots for every different n-gram, however many there are, so false positives stay below
``(HASHES / SLOTS_PER_GRAM) ** HASHES``.

Prediction: the AND of an n-gram's slots gives all languages that contain it. Per-language
popcounts over the text, corrected for each language's false-positive rate
(``(hits - n * fp) / (1 - fp)``), decide; ties go to the first language in order.

Defined cases: null text, or text without a letter, is ``und`` with score 0, as is every
text when nothing could be learned; rows with null language do not train; one result row per
input row, repeated rows and null ids included; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

SIZES = (2, 3, 4)          # n-gram lengths, a word being framed by spaces
FLOOR = 0.05
HASHES = 3
RARE = 1e-6
SLOTS_PER_GRAM = 12        # the filter takes 8 bytes a slot and 62 languages
MASK_BITS = 62
WORD_CACHE = 300_000        # different words a worker counts before it sends them on
WORDS, ROWS = 20_000, 500   # words, texts looked up at once
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str) -> list[str]:
    framed = f" {word} "
    return [framed[i:i + n] for n in SIZES for i in range(len(framed) - n + 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed values), on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chained(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For n = 1, 2, ...: the hashes of all runs of n code points, from those of n - 1."""
    h = _mix(points + np.uint64(1 << 40))
    yield 1, h
    for n in range(2, max(SIZES) + 1):
        h = _mix(h[:max(len(points) - n + 1, 0)] * np.uint64(3) + points[n - 1:])
        yield n, h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hash(gram: str) -> int:
    return int(dict(_chained(_points(gram)))[len(gram)][0].astype(np.int64))


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all words, and the word each belongs to, from one array of
    code points."""
    points = _points("".join([f" {w} " for w in words]))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))    # code points up to the word's end
    hashes, of = [], []
    for n, h in _chained(points):
        if n in SIZES:
            inside = left[:len(h)] >= n
            hashes.append(h[inside])
            of.append(owner[:len(h)][inside])
    return np.concatenate(hashes).astype(np.int64), np.concatenate(of)


def count_grams(train: DataFrame) -> DataFrame:
    """``lang, gram, n``: one partial count per task, then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)

        def emit():
            for lang, counter in words.items():
                h, of = gram_hashes(list(counter))
                times = np.fromiter(counter.values(), np.float64, len(counter))
                keys, place = np.unique(h, return_inverse=True)
                n = np.bincount(place, weights=times[of], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                                                 names=["lang", "gram", "n"])
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[lang].update(words_of(text))
            if sum(map(len, words.values())) > WORD_CACHE:
                yield from emit()
        yield from emit()

    parts = train.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """The bit-sliced Bloom filter: ``masks[block][slot]``, 62 languages a block."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks = langs, masks
        bits = np.array([((masks[b // MASK_BITS] >> np.uint64(b % MASK_BITS)) & np.uint64(1)).mean()
                         for b in range(len(langs))])
        self.false_rate = bits ** HASHES

    def hits(self, words: list[str]) -> np.ndarray:
        """One row a word: the number of its n-grams and each language's hits among them."""
        out = np.zeros((len(words), 1 + len(self.langs)))
        for lo in range(0, len(words), WORDS):
            h, of = gram_hashes(words[lo:lo + WORDS])
            n = min(WORDS, len(words) - lo)
            out[lo:lo + n, 0] = np.bincount(of, minlength=n)
            slots = slot_columns(h, self.masks.shape[1])
            for block, table in enumerate(self.masks):
                found = table[slots[0]]
                for s in slots[1:]:
                    found &= table[s]
                for b in range(block * MASK_BITS, min(len(self.langs), (block + 1) * MASK_BITS)):
                    bit = (found >> np.uint64(b % MASK_BITS)) & np.uint64(1)
                    out[lo:lo + n, 1 + b] = np.bincount(of, weights=bit, minlength=n)
        return out

    def word_hits(self, word: str) -> np.ndarray:
        return self.hits([word])[0]

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, score = self.predict_batch([text])
        return lang[0], float(score[0])

    def predict_batch(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores of a batch: its different words are looked up once."""
        lists = [words_of(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), object, int(sizes.sum()))
        if not self.langs or not len(flat):
            return ["und"] * len(texts), np.zeros(len(texts))
        codes, words = pd.factorize(flat)
        words = words.tolist()
        hits, owner = self.hits(words), np.repeat(np.arange(len(texts)), sizes)
        summed = lambda per_word: np.bincount(owner, weights=per_word[codes], minlength=len(texts))
        letters = summed(np.fromiter((any(map(str.isalpha, w)) for w in words), np.float64, len(words)))
        n = summed(hits[:, 0])
        # language by language: memory does not grow with their number times the words
        corrected = np.stack([(summed(hits[:, 1 + b]) - n * fp) / max(1 - fp, 1e-9) for b, fp in enumerate(self.false_rate)], axis=1)
        best = corrected.argmax(axis=1)
        score = np.clip(corrected[np.arange(len(texts)), best] / np.maximum(n, 1), 0.0, 1.0)
        known = letters > 0
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0)


def slot_columns(h, slots: int):
    """The ``HASHES`` slots of n-gram hashes (numpy), by double hashing."""
    first, step = h & (slots - 1), ((h >> 32) & (slots - 1)) | 1
    return [(first + i * step) & (slots - 1) for i in range(HASHES)]


def learn(train: DataFrame) -> Filter:
    """Fit on rows (text, lang) without nulls."""
    spark = train.sparkSession
    prepare(spark)
    from .common import materialise

    counts = materialise(count_grams(train), "lang-grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Filter([], np.zeros((1, 1), dtype=np.uint64))
    total_of = F.create_map(*[F.lit(x) for k in langs for x in (k, float(totals[k]))])
    bit_of = F.create_map(*[F.lit(x) for b, k in enumerate(langs) for x in (k, b)])
    x = counts.select("gram", bit_of[F.col("lang")].alias("bit"), (F.col("n") / total_of[F.col("lang")]).alias("rate"))
    top = x.filter(F.col("rate") >= RARE).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate")).alias("of"))
    member = top.select("gram", F.explode(F.filter("of", lambda r: r["rate"] >= F.col("top") * FLOOR)).alias("m"))
    member = member.select("gram", "m.bit")
    member = materialise(member, "lang-members")
    n = member.select("gram").distinct().count()
    slots = 1 << (max(n * SLOTS_PER_GRAM, 1 << 10) - 1).bit_length()
    first, step = F.col("gram").bitwiseAND(slots - 1), F.shiftright("gram", 32).bitwiseAND(slots - 1).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(first + step * i).bitwiseAND(slots - 1) for i in range(HASHES)]))
    rows = member.select(at.alias("slot"), F.floor(F.col("bit") / MASK_BITS).alias("block"),
                         F.expr(f"shiftleft(1L, cast(bit % {MASK_BITS} as int))").alias("mask"))
    # at most one row a slot and block
    cells = rows.groupBy("block", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((-(-len(langs) // MASK_BITS), slots), dtype=np.uint64)
    masks[cells["block"].to_numpy(np.int64), cells["slot"].to_numpy(np.int64)] = cells["mask"].to_numpy(np.int64).astype(np.uint64)
    return Filter(langs, masks)


def predict(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lang, score = own.predict_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (0 for a null id)."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def identify(docs: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """Contract columns: learned on the folds other than ``held_out``, predicted for all."""
    part = fold(F.col("doc_id"), folds)
    train = docs.filter((part != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    out = predict(docs, learn(train.select("text", "lang")))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")
