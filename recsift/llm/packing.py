"""Best-fit packing of documents into sequences by a linear grouping scheme.

1. Texts are tokenised in Arrow batches; every piece keeps its length and its running
   number among the pieces of that length in its task.
2. Only the histogram of lengths (at most ``capacity`` rows) reaches the driver. There
   the large lengths are cut into groups of equal cardinality and rounded up to the
   group's largest; the configurations of these few sizes are optimised (cutting-stock
   linear program, columns generated by a knapsack table) and rounded down; the actual
   lengths take the rounded ones' places; what is left, and the small lengths, go best-fit
   (longest first) into the gaps. All steps work on runs of equal sequences, so the plan
   has a size that depends on ``capacity`` and not on the number of documents.
3. A piece's number among all pieces of its length (a prefix sum over tasks) picks its
   row of the broadcast plan and with it sequence and offset.

Defined cases: null or empty text is one piece with the end id only; repeated rows are
packed each; a null doc_id is packed like any other; an empty table gives an empty
result; other columns are ignored. A piece never exceeds ``capacity``.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialise, prepare

CAPACITY = 4096
GROUPS = 24
SMALL_SHARE = 8            # lengths up to capacity / SMALL_SHARE are small
WORD_CACHE = 300_000       # words, and parts, above which a task remembers those of its last run only
LONG = 64                  # longer parts are not remembered
RUN_BYTES = 4_000_000      # text encoded at once (a longer text is a run of its own)
WORDS_AT_ONCE = 5_000      # unseen words that the tokenizer gets at once
PLAN_ROWS = 500_000        # far above what any histogram of CAPACITY lengths can give


# ---- tokens ---------------------------------------------------------------

class _Parts(dict):
    """Ids (4 bytes each) of space-separated parts, remembered. The tokenizer
    drops white space and never joins across it, and it never joins letters with ASCII
    punctuation, so a plain word's ids are those of its punctuation, its lower-cased
    letters and its punctuation. Letters go to the tokenizer's model without its text
    normaliser, as the byte-level alphabet spells them, all unseen ones of a run at once."""

    # apostrophes are left out: the tokenizer knows some contractions
    PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()] if added else []
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # the last id of a word tells it, if the model has a suffix for that
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        ids = self.tok.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(ids.values(), default=0) + 1, bool)
        self.last[[i for t, i in ids.items() if suffix and t.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        # byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256
        other = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.spelling = {b: chr(256 + i) for i, b in enumerate(other) if b != 32}

    def encode(self, part: str) -> bytes:
        return array("I", self.tok.encode(part, add_special_tokens=False).ids).tobytes()

    def learn_letters(self, new: list[str]) -> None:
        """Remember the ids of words of letters; the tokenizer's model gets them at once."""
        spelled = " ".join(new)
        if not spelled.isascii():
            spelled = spelled.encode().decode("latin-1").translate(self.spelling)
        ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            if len(new) > 1:
                for word in new:
                    self.learn_letters([word])
                return
            ends = np.array([len(ids)])
        flat, ends = ids.tobytes(), (4 * ends).tolist()
        self.words.update(zip(new, [flat[a:b] for a, b in zip([0, *ends], ends)]))

    def learn_words(self, new: list[str]) -> None:
        """Letters, or punctuation."""
        letters = [w for w in new if w[0].isalpha()]
        if len(letters) < len(new):
            self.words.update((w, self.encode(w)) for w in new if not w[0].isalpha())
        for some in ([w for w in letters if w.isascii()], [w for w in letters if not w.isascii()]):
            for at in range(0, len(some), WORDS_AT_ONCE):
                self.learn_letters(some[at:at + WORDS_AT_ONCE])

    def learn(self, new: list[str]) -> None:
        """Remember the ids of parts, none of them long."""
        joined, plain = " ".join(new), self.PLAIN.fullmatch
        added = [t for t in self.added if t in joined]
        words, seen, easy, marked = self.words, [], [], []
        for part in new:
            if part.isascii() and part.isalpha() and not added:     # most parts
                easy.append(part)
            elif (m := plain(part)) and not any(t in part for t in added):
                groups = [g for g in (m[1], m[2].lower(), m[3]) if g]
                seen += groups
                marked.append((part, groups))
            else:
                self[part] = self.encode(part)
        low = [p.lower() for p in easy]
        seen += low
        self.learn_words([w for w in dict.fromkeys(seen) if w not in words])
        self.update(zip(easy, map(words.__getitem__, low)))
        self.update((p, b"".join([words[g] for g in groups])) for p, groups in marked)
        if len(words) > WORD_CACHE:
            kept = {w: words[w] for w in seen}
            words.clear()
            words.update(kept)

    def __missing__(self, part: str) -> bytes:
        if len(part) > LONG:
            return self.encode(part)
        self.learn([part])
        return self[part]

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id after each, and where each text's ids begin (and the last ones end)."""
        lists = pa.compute.split_pattern(pa.compute.replace_substring(pa.compute.fill_null(texts, ""), "\n", " "), " ")
        found = lists.flatten().dictionary_encode()
        # no part has a space; this is much faster than to_pylist
        parts = pa.compute.binary_join(pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary), " ")[0].as_py()
        parts, index = parts.split(" ") if len(found.dictionary) else [], found.indices.to_numpy()
        self.learn([p for p in parts if p not in self and len(p) <= LONG])
        coded = list(map(self.__getitem__, parts))
        if len(self) > WORD_CACHE:
            self.clear()
            self.update((p, c) for p, c in zip(parts, coded) if len(p) <= LONG)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        table = np.frombuffer(b"".join(coded), "<u4")
        n = sizes[index]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - n), n) + np.arange(len(n) and ends[-1])
        count = pa.compute.list_value_length(lists).to_numpy()
        ends = np.r_[0, ends][np.cumsum(count)]
        return np.insert(table[at], ends, end_id), np.r_[0, ends + np.arange(1, len(ends) + 1)]

    def forget(self) -> None:
        """A worker outlives its task: what the task remembered goes back."""
        self.clear()
        self.words.clear()
        give_back()


_TOKENIZERS: dict[tuple[str, bool], _Parts] = {}   # one tokenizer for each file, mode and worker process


def encoder(path: str, added: bool = False) -> _Parts:
    if (path, added) not in _TOKENIZERS:
        _TOKENIZERS[path, added] = _Parts(path, added)
    return _TOKENIZERS[path, added]


def runs_of(whole: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``RUN_BYTES`` of text."""
    size = pa.compute.fill_null(pa.compute.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size, dtype=np.int64) // RUN_BYTES
    for a, b in pairwise(np.flatnonzero(np.r_[True, run[1:] != run[:-1], True]).tolist() if len(run) else []):
        for at in range(a, b, 10_000):
            yield whole.slice(at, min(10_000, b - at))


def tokenise_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1,
                    keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], task, nth``. With ``added`` the tokenizer's added
    tokens (``<|endoftext|>``) that a text holds get their own ids, as the tokenizer is loaded;
    else they are spelled."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen, task = encoder(tokenizer, added), {}, TaskContext.get().partitionId()
        try:
            for whole in batches:
                for batch in runs_of(whole):
                    cols = {k: [] for k in ("row", "piece", "start", "length", "crc", "nth", "ids")}
                    ids, starts = parts.encode_all(batch.column(1), end_id)
                    for i, (first, last) in enumerate(pairwise(starts.tolist())):
                        for piece, start in enumerate(range(first, last, capacity)):
                            part = ids[start:min(start + capacity, last)]
                            n = len(part)
                            seen[n] = nth = seen.get(n, -1) + 1
                            for k, v in zip(cols, (i, piece, start - first, n, zlib.crc32(part), nth, part if keep_ids else None)):
                                cols[k].append(v)
                    out = [batch.column(0).take(pa.array(cols["row"], pa.int64())), pa.array(cols["piece"], pa.int32()),
                           pa.array(cols["start"], pa.int64()), pa.array(cols["length"], pa.int64()),
                           pa.array(cols["crc"], pa.int64())]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if keep_ids:
                        out.append(pa.array([p.view("<i4") for p in cols["ids"]], pa.list_(pa.int32())))
                        names.append("ids")
                    out += [pa.array([task] * len(cols["row"]), pa.int32()), pa.array(cols["nth"], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, names=[*names, "task", "nth"])
        finally:
            parts.forget()

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, {fields}, task int, nth long")


# ---- the plan (driver, on the histogram) ------------------------------------

def optimise_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Cutting stock for a few sizes: columns (copies of each size) with the amounts of
    the linear program's optimum."""
    k = len(sizes)
    size = np.array(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    amount = np.array(demand, dtype=float) / np.diag(basis)
    for _ in range(40 * k + 200):
        inv = np.linalg.inv(basis)
        price = inv.sum(axis=0)          # every sequence costs 1
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        # unbounded knapsack over the capacity
        order = np.argsort(size)
        for i in order:
            s, v = int(size[i]), price[i]
            if v <= 1e-12:
                continue
            for lo in range(s, capacity + 1, s):   # blocks of s entries depend on the block before only
                hi = min(lo + s, capacity + 1)
                cand = best[lo - s:hi - s] + v
                better = cand > best[lo:hi] + 1e-12
                best[lo:hi] = np.where(better, cand, best[lo:hi])
                pick[lo:hi] = np.where(better, i, pick[lo:hi])
        at = int(np.argmax(best))
        if best[at] <= 1 + 1e-7:
            break
        column = np.zeros(k)
        while at > 0 and pick[at] >= 0:
            column[pick[at]] += 1
            at -= int(size[pick[at]])
        direction = inv @ column
        ok = direction > 1e-9
        ratio = np.where(ok, amount / np.where(ok, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        step = ratio[leave]
        amount = np.maximum(amount - step * direction, 0)
        amount[leave] = step
        basis[:, leave] = column
    return [(basis[:, j].round().astype(int).tolist(), float(amount[j])) for j in range(k) if amount[j] > 1e-9]


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple]:
    """Rows (length, first, n, per_seq, seq, offset): the pieces of that length numbered
    ``first + q`` (q < n) go to sequence ``seq + q // per_seq`` at
    ``offset + (q % per_seq) * length``."""
    rows: list[tuple] = []
    used = dict.fromkeys(histogram, 0)
    next_seq = 0
    spaces: dict[int, list[list[int]]] = {}   # free tokens -> runs [first sequence, number]
    free_mask = 0

    def release(first: int, n: int, free: int) -> None:
        nonlocal free_mask
        if n > 0 and free > 0:
            spaces.setdefault(free, []).append([first, n])
            free_mask |= 1 << free

    def put(length: int, n: int, per: int, seq: int, offset: int) -> None:
        rows.append((length, used[length], n, per, seq, offset))
        used[length] += n

    # large lengths, longest first, in groups of equal cardinality
    limit = capacity // SMALL_SHARE
    large = sorted((x for x in histogram if x > limit), reverse=True)
    total = sum(histogram[x] for x in large)
    runs: list[list[list[int]]] = []          # per group: [length, count] runs, longest first
    if total:
        want = -(-total // min(groups, total))
        room = 0
        for x in large:
            left = histogram[x]
            while left:
                if not room:
                    runs.append([])
                    room = want
                take = min(left, room)
                runs[-1].append([x, take])
                left, room = left - take, room - take
        merged: dict[int, list] = {}          # groups of the same rounded length are one size
        for g in runs:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        pools = [merged[s] for s in sizes]
        demand = [sum(c for _, c in p) for p in pools]
        for config, amount in optimise_configurations(sizes, demand, capacity):
            n = int(amount + 1e-6)
            for i, a in enumerate(config):
                if a:
                    n = min(n, demand[i] // a)
            if n <= 0:
                continue
            for i, a in enumerate(config):
                demand[i] -= a * n
            slots = [i for i, a in enumerate(config) for _ in range(a)]
            # actual lengths for the slots: runs of sequences with the same lengths
            lists = []
            for i in slots:
                need, got = n, []
                while need:
                    x = pools[i][0]
                    take = min(need, x[1])
                    got.append([x[0], take])
                    x[1] -= take
                    need -= take
                    if not x[1]:
                        pools[i].pop(0)
                lists.append(got)
            done = 0
            while done < n:
                step = min(g[0][1] for g in lists)
                offset = 0
                for g in lists:
                    put(g[0][0], step, 1, next_seq + done, offset)
                    offset += g[0][0]
                    g[0][1] -= step
                    if not g[0][1]:
                        g.pop(0)
                release(next_seq + done, step, capacity - offset)
                done += step
            next_seq += n

    # the rest, longest first: the tightest gap, else new sequences
    for length in sorted(histogram, reverse=True):
        left = histogram[length] - used[length]
        while left:
            fits = free_mask >> length
            if fits:
                free = length + (fits & -fits).bit_length() - 1
                first, n = spaces[free].pop()
                if not spaces[free]:
                    free_mask &= ~(1 << free)
            else:
                free, first = capacity, next_seq
                n = max(1, left // (capacity // length))
                next_seq += n
            per = min(free // length, left)
            full = min(n, left // per)
            put(length, full * per, per, first, capacity - free)
            release(first, full, free - per * length)
            release(first + full, n - full, free)
            left -= full * per
    return rows


# ---- packing ------------------------------------------------------------------

def place(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (``task, nth`` pinned)."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = packing_plan(histogram, capacity, groups)
    if len(plan) > PLAN_ROWS:
        raise ValueError(f"the plan has {len(plan)} rows; lower groups or capacity")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("task").alias("t"), F.col("length").alias("l"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    table = spark.createDataFrame(plan, "p_length long, p_first long, p_n long, p_per long, p_seq long, p_offset long")
    x = pieces.join(first, (pieces["task"] == first["t"]) & (pieces["length"] == first["l"]))
    x = x.withColumn("rank", F.col("base") + F.col("nth"))
    x = x.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_first"))
               & (F.col("rank") < F.col("p_first") + F.col("p_n")))
    q = F.col("rank") - F.col("p_first")
    per = F.col("p_per")
    return (x.withColumn("sequence_id", F.col("p_seq") + F.floor(q / per))
            .withColumn("offset", F.col("p_offset") + F.pmod(q, per) * F.col("length"))
            .drop("t", "l", "base", "rank", "nth", "task", *table.columns))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, groups: int = GROUPS,
                   keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``."""
    pieces = tokenise_pieces(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col, added)
    return place(materialise(pieces, "pieces"), capacity, groups)


def assemble(packed: DataFrame) -> DataFrame:
    """Packed pieces with ``ids`` -> ``sequence_id, ids, doc_starts`` (a sequence holds at
    most ``capacity`` ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["offset"]).alias("doc_starts"))
