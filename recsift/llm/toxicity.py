"""Toxicity by noisy-channel deobfuscation.

Restoring: a token with other characters among or beside its letters, a repeated letter,
or a run of single spaced characters is a lattice: a character may stand for itself, for the
letters its look-alikes stand for, or (separators, repeated letters) for nothing, each at a
channel cost; in a spaced run a word may end after any character. Viterbi decoding under a character trigram model, counted over all texts,
gives the restored words; it is exact (a state is the last two characters). Tokens without such characters are their own only path;
numbers and prices are no words and stay.

Scoring: words and word beginnings of restored training texts get evidence weights (a
cautious log odds from counts over the labelled training rows, about ``TRAIN_ROWS`` at most, near
copies counted once).
A text's evidence is the sum over its different words; a logistic curve over evidence and
length, fitted on about ``FIT_ROWS`` labelled training rows at most, gives the score.

Memory: a worker holds the model (trigrams above ``GRAM_FLOOR`` of all, at most ``MODEL_ROWS`` weights), memories of
at most ``TOKENS`` tokens and ``CONTEXTS`` contexts, and ``ROWS`` texts at a time, whatever the size of the input.

Defined cases: null text is empty; an empty text has no evidence and still a score; labels of
null toxicity or unknown documents are ignored, repeated labels of a document count once
(the higher); without any training label every score is 0; one result row per input row,
repeated rows and null ids included; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialise, prepare
from .langid import fold

TRAIN_ROWS = 400_000    # about the most labelled rows that train (by hash of the id; their ids are broadcast)
FIT_ROWS = 40_000       # about the most rows the logistic curve is fitted on
MODEL_ROWS = 20_000     # bound of the evidence table (strongest weights first)
GRAM_FLOOR = 1e-6       # share of all trigrams below which one is left to the back-off (so at most a million are kept)
MIN_POSITIVE, MIN_WEIGHT = 4, 2.0
PREFIXES = (4, 5, 6, 7)
WORD_CACHE = 100_000      # words a worker counts before it sends them on
TOKENS = 60_000           # tokens whose restored words a worker remembers
CONTEXTS = 100_000        # trigram probabilities a worker remembers
EVIDENCE_CACHE = 150_000  # features a worker counts before it sends them on
ROWS = 300                # texts taken out of an Arrow batch at once

# Letters a character may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
               "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
COST_LOOK_ALIKE, COST_SEPARATOR, COST_REPEAT, COST_NOTHING, COST_OTHER, COST_BREAK = 0.7, 0.7, 0.4, 1.2, 6.0, 0.7

# single characters, each followed by one separator, not beside a letter or digit
_SPACED = re.compile(r"(?<![^\W_])(?:[^\s][ .\-_*]){2,}[^\s](?![^\W_])")
_SEPARATOR = re.compile(r"[ .\-_*]")
_DOUBLE = re.compile(r"(.)\1")
_EDGE = ".,;:?\"'[]{}<>)*#%&/\\=^_~`-"     # no letters, digits or look-alikes
_DOUBLES = re.compile(r"(.)\1+")
_NUMBER = re.compile(r"[€£$+(]*[\d.,:/%\-]*[%€£$+)!]*")


class TrigramModel:
    """Interpolated character trigrams of framed words."""

    def __init__(self, counts: dict[str, int]):
        self.tri = counts
        self.bi: Counter = Counter()
        self.uni: Counter = Counter()
        self.pair: Counter = Counter()
        for g, n in counts.items():
            self.bi[g[:2]] += n
            self.pair[g[1:]] += n
            self.uni[g[2]] += n
        self.single: Counter = Counter()
        for g, n in self.pair.items():
            self.single[g[0]] += n
        self.total = sum(self.uni.values()) or 1
        self.seen: dict[str, float] = {}

    def log_p(self, context: str, c: str) -> float:
        key = context + c
        got = self.seen.get(key)
        if got is None:
            p3 = self.tri.get(key, 0) / self.bi[context] if self.bi[context] else 0.0
            p2 = self.pair[key[1:]] / self.single[context[1]] if self.single[context[1]] else 0.0
            p1 = (self.uni[c] + 0.1) / (self.total + 10)
            if len(self.seen) >= CONTEXTS:
                self.seen.clear()
            got = self.seen[key] = math.log(0.7 * p3 + 0.25 * p2 + 0.05 * p1)
        return got


    def word_log_p(self, word: str) -> float:
        framed, seen = f"  {word} ", self.seen
        total = 0.0
        for i in range(len(word) + 1):
            p = seen.get(framed[i:i + 3])
            total += self.log_p(framed[i:i + 2], framed[i + 2]) if p is None else p
        return total


def trigrams(word: str) -> list[str]:
    framed = f"  {word} "
    return [framed[i:i + 3] for i in range(len(framed) - 2)]


def core_of(token: str) -> str:
    """The token without the punctuation around it; look-alikes stay."""
    if token.isalpha():
        return token
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] in LOOK_ALIKES):
        a += 1
    while b > a and not (token[b - 1].isalnum() or token[b - 1] in LOOK_ALIKES):
        b -= 1
    if b - a > 2 and token[b - 1] in "@$" and token[b - 3:b] == token[b - 1] * 3:   # decoration, no letters
        return core_of(token[a:b].rstrip(token[b - 1]))
    return token[a:b]


def arcs(core: str, i: int, spaced: bool) -> list[tuple[str, float]]:
    """What character ``i`` may stand for, with its channel cost."""
    ch = core[i]
    again = i > 0 and core[i - 1] == ch and not spaced
    if ch.isalpha():
        return [(ch, 0.0), ("", COST_REPEAT)] if again else [(ch, 0.0)]
    out = [(x, COST_LOOK_ALIKE) for x in LOOK_ALIKES.get(ch, "")]
    out.append((ch, COST_OTHER) if ch.isalnum() else ("", COST_NOTHING if out else COST_SEPARATOR))
    if again and (i > 1 and core[i - 2] == ch or core[i + 1:i + 2] == ch):     # two may be a double letter
        out.append(("", COST_REPEAT))
    return out


def decode(core: str, lm: TrigramModel, spaced: bool = False) -> str:
    """Best path through the lattice of one token, or of a run of spaced characters (words
    separated by a space)."""
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    for i in range(len(core)):
        nxt: dict[str, tuple[float, tuple | None]] = {}

        def reach(context: str, score: float, path: tuple | None) -> None:
            old = nxt.get(context)
            if old is None or score > old[0]:
                nxt[context] = (score, path)
        options = arcs(core, i, spaced)
        for context, (score, path) in states.items():
            for out, cost in options:
                s = score - cost
                if not out:
                    reach(context, s, path)
                    continue
                s += lm.log_p(context, out)
                after = context[1] + out
                reach(after, s, (path, out))
                if spaced and i + 1 < len(core):
                    reach("  ", s + lm.log_p(after, " ") - COST_BREAK, (path, out + " "))
        states = nxt
    score, path = max(((s + lm.log_p(c, " "), p) for c, (s, p) in states.items()), key=lambda x: x[0])
    parts = []
    while path is not None:
        path, out = path
        parts.append(out)
    return "".join(reversed(parts)).strip()


def repeats(core: str, lm: TrigramModel) -> str:
    """:func:`decode` for letters only: with few repeated ones, the few paths one by one."""
    again = [i for i in range(1, len(core)) if core[i] == core[i - 1]]
    if len(again) > 3:
        return decode(core, lm)
    best = (lm.word_log_p(core), core)
    for n in range(1, len(again) + 1):
        for gone in combinations(again, n):
            word = "".join([c for i, c in enumerate(core) if i not in gone])
            best = max(best, (lm.word_log_p(word) - n * COST_REPEAT, word))
    return best[1]


def restore(token: str, lm: TrigramModel) -> str:
    core = core_of(token)
    if core.isalpha():
        return repeats(core, lm) if _DOUBLE.search(core) else core
    if _NUMBER.fullmatch(core):
        return core
    return decode(core, lm)


def restore_run(run: str, lm: TrigramModel) -> str:
    """The words of a run of spaced characters; a run of numbers stays."""
    core = _SEPARATOR.sub("", run)
    return core if _NUMBER.fullmatch(core) else decode(core, lm, spaced=True)


def tokens_of(text: str) -> list[str]:
    """The tokens of a text, then its spaced runs (told by the space or separator inside a leading mark)."""
    low = text.lower()
    return low.split() + [RUN + m.group() for m in _SPACED.finditer(low)]


RUN = "\x00"     # marks a spaced run among tokens


def words_of(token: str, lm: TrigramModel) -> list[str]:
    """The restored words of one of :func:`tokens_of`'s tokens."""
    return restore_run(token[1:], lm).split() if token[0] == RUN else [restore(token, lm)]


def restore_text(text: str, lm: TrigramModel) -> str:
    """The whole text with every spaced run and token restored."""
    out, at, low = [], 0, text.lower()
    for m in _SPACED.finditer(low):
        out += [restore(t, lm) for t in low[at:m.start()].split()] + [restore_run(m.group(), lm)]
        at = m.end()
    return " ".join(out + [restore(t, lm) for t in low[at:].split()])


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


# ---- language model -----------------------------------------------------------

def _packed_trigrams(words: list[str], times: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The trigrams of :func:`trigrams` over all words, with their counts."""
    if not words:
        return [], np.zeros(0, np.int64)
    points = np.frombuffer("".join([f"  {w} " for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    packed = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[left[:-2] >= 3]
    keys, place = np.unique(packed, return_inverse=True)
    counts = np.bincount(place, weights=np.repeat(times, sizes - 2), minlength=len(keys)).astype(np.int64)
    low = (1 << 21) - 1
    return [chr(k >> 42) + chr(k >> 21 & low) + chr(k & low) for k in keys.tolist()], counts


def count_trigrams(texts: DataFrame) -> DataFrame:
    """``gram, n`` over the letter words of all texts."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def emit():
            # different words only, as one array of code points
            letters: Counter = Counter()
            for w, n in words.items():
                w = core_of(w)
                if w.isalpha():
                    letters[w] += n
            words.clear()
            grams, counts = _packed_trigrams(list(letters), np.fromiter(letters.values(), np.int64, len(letters)))
            yield pa.RecordBatch.from_pydict({"gram": pa.array(grams, pa.string()), "n": pa.array(counts, pa.int64())})
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for text in batch.column(0).slice(at, ROWS).to_pylist():
                    if text:
                        words.update(text.lower().split())
                    if len(words) > WORD_CACHE:
                        yield from emit()
        yield from emit()

    return texts.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def learn_language(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Trigrams of all texts above ``GRAM_FLOOR`` of all."""
    grams = materialise(count_trigrams(docs.select(F.col(text_col).cast("string").alias("text"))), "toxic-trigrams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    return {r["gram"]: r["n"] for r in grams.filter(F.col("n") >= F.lit(total * GRAM_FLOOR)).collect()}


# ---- evidence -------------------------------------------------------------------

class Scorer:
    def __init__(self, grams: dict[str, int], weights: dict[str, float]):
        self.lm, self.weights = TrigramModel(grams), weights
        # a word that begins like no feature needs no look-up
        self.starts = {f[:PREFIXES[0]] for f in weights}
        # dropping repeated letters leaves the run-free form as it is: a word that begins otherwise gives no feature
        self.singles = {_DOUBLES.sub(r"\1", f) for f in self.starts}
        self.known: dict[str, list[str]] = {}

    def words(self, token: str) -> list[str]:
        token = token if token.isalpha() else token.strip(_EDGE) or token
        if token.isalpha() and not _DOUBLE.search(token):
            return [token]
        got = self.known.get(token)
        if got is None:
            got = words_of(token, self.lm)
            if len(token) <= 64:
                if len(self.known) >= TOKENS:
                    self.known.clear()
                self.known[token] = got
        return got

    def evidence(self, text: str | None) -> tuple[float, int]:
        tokens = set(tokens_of(text)) if text else set()
        found, starts, n = set(), self.starts, PREFIXES[0]
        for t in tokens:
            t = t if t.isalpha() else t.strip(_EDGE) or t     # as core_of does, for the usual characters
            if t.isalpha():
                if not _DOUBLE.search(t):
                    if t[:n] in starts:
                        found.add(t)
                    continue
                single = _DOUBLES.sub(r"\1", t)
                if not any(single[:i] in self.singles for i in range(1, n + 1)):
                    continue
            for w in self.words(t):
                if w[:n] in starts:
                    found.add(w)
        return sum(max([0.0, *(self.weights.get(f, 0.0) for f in features_of(w))]) for w in sorted(found)), len(tokens)


def count_evidence(train: DataFrame, grams: dict[str, int]) -> DataFrame:
    """``feature, pos, neg``: labelled texts with the feature. ``train`` has text, toxic."""
    sent = train.sparkSession.sparkContext.broadcast(grams)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, {})
        pos, neg = Counter(), Counter()

        def emit():
            keys = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(keys, pa.string()), "pos": pa.array([pos[k] for k in keys], pa.int64()),
                "neg": pa.array([neg[k] for k in keys], pa.int64())})
            pos.clear()
            neg.clear()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = {f for t in set(tokens_of(text or "")) for w in scorer.words(t) for f in features_of(w)}
                    found.add("")      # counts the texts
                    (pos if toxic else neg).update(found)
                    if len(pos) + len(neg) > EVIDENCE_CACHE:
                        yield from emit()
        yield from emit()

    parts = train.select("text", "toxic").mapInArrow(run, "feature string, pos long, neg long")
    return parts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _sketch(words):
    """Smallest hash of three consecutive words: near copies share it. ``words`` is a column
    of its own, an expression would be evaluated for every word."""
    w = F.col(words)
    return F.array_min(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))


def learn_weights(train: DataFrame, grams: dict[str, int]) -> dict[str, float]:
    words = train.select("doc_id", "toxic", F.split(F.coalesce("text", F.lit("")), " ").alias("words"))
    first = words.select("doc_id", "toxic", _sketch("words").alias("sketch")).groupBy("toxic", "sketch").agg(
        F.min("doc_id").alias("f_id")).select("f_id")
    # at most TRAIN_ROWS ids
    one = train.join(F.broadcast(first), F.col("doc_id") == F.col("f_id"), "left_semi")
    counts = materialise(count_evidence(one.select("text", "toxic"), grams).filter(
        (F.col("pos") >= MIN_POSITIVE) | (F.col("feature") == "")), "toxic-evidence")
    totals = counts.filter("feature = ''").first()
    if totals is None or not totals["pos"] or not totals["neg"]:
        return {}
    # one standard error against the feature
    low, high = F.col("pos") - F.sqrt("pos"), F.col("neg") + F.sqrt("neg") + 1
    weight = F.log(low / float(totals["pos"])) - F.log(high / float(totals["neg"]))
    best = counts.filter("feature <> ''").select("feature", weight.alias("w")).filter(F.col("w") >= MIN_WEIGHT)
    return {r["feature"]: r["w"] for r in best.orderBy(F.desc("w"), "feature").limit(MODEL_ROWS).collect()}


def evidence(docs: DataFrame, grams: dict, weights: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns + ``__evidence, __n_tokens``."""
    sent = docs.sparkSession.sparkContext.broadcast((grams, weights))
    place = keep.index(text_col) if text_col in keep else len(keep)
    kept = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                out = [scorer.evidence(t) for t in batch.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(keep))), pa.array([o[0] for o in out], pa.float64()),
                     pa.array([o[1] for o in out], pa.int64())], names=[*keep, "__evidence", "__n_tokens"])

    return kept.mapInArrow(run, f"{schema}, __evidence double, __n_tokens long")


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - 1e-2 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    def __init__(self, grams, weights, beta):
        self.grams, self.weights, self.beta = grams, weights, beta


def learn(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, folds: int = 5) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic); the rows of fold ``held_out`` do
    not train (their texts still count in the language model)."""
    prepare(docs.sparkSession)
    grams = learn_language(docs)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        known = known.filter(fold(F.col("l_id"), folds) != held_out)
    known = share_of(materialise(known, "toxic-labels"), "l_id", TRAIN_ROWS)
    train = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id")) \
        .select("doc_id", "text", "toxic")
    train = materialise(train, "toxic-train")
    weights = learn_weights(train, grams)
    if not weights:
        return Model(grams, {}, np.array([-30.0, 0.0, 0.0]))
    rows = evidence(share_of(train, "doc_id", FIT_ROWS), grams, weights, ["doc_id", "toxic"])
    sample = rows.select("__evidence", "__n_tokens", "toxic").toPandas()
    x = _inputs(sample["__evidence"].to_numpy(float), sample["__n_tokens"].to_numpy(float))
    return Model(grams, weights, fit_curve(x, sample["toxic"].to_numpy(float)))


def share_of(rows: DataFrame, key: str, most: int) -> DataFrame:
    """All rows, or those of a counted share of the key's hashes, so that about ``most`` are left."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))


def _inputs(e: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(e)), np.minimum(e, 20.0), np.log1p(n)])


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text",
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns + score and prediction under ``names``."""
    x = evidence(docs, model.grams, model.weights, keep, text_col)
    b = [float(v) for v in model.beta]
    z = F.lit(b[0]) + F.least(F.col("__evidence"), F.lit(20.0)) * b[1] + F.log1p("__n_tokens") * b[2]
    return x.select(*keep, (1 / (1 + F.exp(-z))).alias(names[0])) \
        .withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))
