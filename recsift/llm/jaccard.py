"""N-gram Jaccard join: size-aware heavy-light.

Documents are sets of word shingles; equal sets are one class. Classes are put into size
classes so wide that linked sets lie in the same or in neighbouring ones; a label stands for
"this class and the one below". For a label, linked sets differ in at most D shingles.

*Light labels (small sets): fixed-size subsets.* The shingle universe is cut by hash into D + 2
cells. Linked sets agree on at least two whole cells, so every subset of two cells is
enumerated as a join key.

*Heavy labels (large sets): inverted lists.* With more than D cells, linked sets agree on at
least one whole cell (so many cells that an empty one need not count); sets that share no cell
with another set are out. Over the remaining sets
shingles are counted; a set's shingles are ordered rarest first, and only its prefix (as many
as a linked set could miss, plus one, shingles no other set has not counting) enters the lists.

*Boundary by cost.* A label is light while enumerating C(D + 2, 2) keys costs no more rows than
D + 1 keys plus the set's shingles in the counting of the lists.

*Scanning without all pairs.* First every member of a list is checked against one centre (the
member with the fewest shingles of its own); verified links give components. Then only
pairs of a list that lie in different components, and can reach the overlap from that
shingle on, are checked.
Before the sets of a pair are brought together, short parity sketches rule out most pairs
that are not linked (a lower bound of their difference, so no link is lost).
Every pair of linked sets shares a list, so the components are those of all links.

Defined cases: null or empty text, or text without words: empty set, n_shingles 0, linked with
nothing; fewer words than ``k``: the sequence is the only shingle; repeated rows are copies of
one class; a null doc_id is never a component's smallest id (a class of null ids only has a
null component_id); one doc_id may stand for several texts; an empty table gives an empty result; other columns are ignored.
Shingles are compared as 64-bit and whole sets as 128-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, give_back, giving_back, materialise, prepare, release
from .components import connected_components

WORD_CACHE = 400_000
BUCKET_KEYS = 500_000              # keys of a bucket, and half of those a task holds at once
ROWS = 1000                        # sets whose keys are taken out of an Arrow batch at once
SKETCH_WORDS = 8                   # 64-bit words of a set's parity sketch
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M3
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def shingles(text: str | None, known: _Words, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of the words ``[^\\x20\\x09-\\x0D]+``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    out = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        out = _mix(out * _M1 + h[i:len(h) - k + 1 + i])
    return np.unique(_mix(out))


# ---- size classes ---------------------------------------------------------------

class Labels:
    """Size classes, differences and the light/heavy boundary of a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges = num, den, [1]

    def class_of(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def difference(self, label: int) -> int:
        self.class_of(1)
        while len(self.edges) <= label + 1:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        return 2 * (self.edges[label + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def cells(self, label: int) -> int:
        """Cells of a heavy label: D + 1, and as many more as a set of the label's smallest
        size is likely to leave empty."""
        d, m = self.difference(label), self.difference(label) + 1
        for _ in range(20):
            empty = m * math.exp(-self.edges[max(label - 1, 0)] / m)
            m = d + 1 + math.ceil(empty + 3 * math.sqrt(empty))
        return m

    def light(self, label: int) -> bool:
        d = self.difference(label)
        return (d + 2) * (d + 1) // 2 <= d + 1 + self.edges[label] // 2


@lru_cache(maxsize=4096)
def _cells(m: int) -> np.ndarray:
    return np.array([-(-(i << 64) // m) for i in range(1, m)], dtype=np.uint64)


@lru_cache(maxsize=256)
def _subsets(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def keys_of(s: np.ndarray, labels: Labels) -> tuple[np.ndarray, np.ndarray]:
    """(light keys, heavy keys) of one set."""
    light, heavy = [], []
    if len(s):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s + _M1), dtype=np.uint64)])
        c = labels.class_of(len(s))
        for label in (c, c + 1):
            d = labels.difference(label)
            if d == 0:
                continue          # different sets of these sizes are never linked
            is_light = labels.light(label)
            m = d + 2 if is_light else labels.cells(label)
            at = np.concatenate([[0], np.searchsorted(s, _cells(m)), [len(s)]])
            content = sums[at[1:]] - sums[at[:-1]]
            cell = _mix(content + (np.arange(m, dtype=np.uint64) + np.uint64(label << 32)) * _M1)
            if is_light:
                i, j = _subsets(m)
                light.append(_mix(cell[i] * _M3 + cell[j]))
            else:
                # two sets agree on m - d cells; with no more than m - d - 1 empty ones in either
                # set, one of the others is among them
                full = at[1:] > at[:-1]
                heavy.append(cell[full] if m - full.sum() <= m - d - 1 else cell)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(light), join(heavy)


# ---- passes over the texts ---------------------------------------------------------

def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _signature(s: np.ndarray) -> tuple[int, int]:
    raw = s.tobytes()
    return tuple(xxhash.xxh64_intdigest(raw, seed) - (1 << 63) for seed in (0, 1))


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of ``64 * SKETCH_WORDS`` hash cells."""
    bits = 64 * SKETCH_WORDS
    counts = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def set_table(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored ``rid, doc_id, text_hash, n, s1, s2``, one row per document, and the same rows with
    their keys (``light, heavy``), which are large and read only while the lists are made."""
    kind = docs.schema[id_col].dataType.simpleString()

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, labels = _Words(), Labels(num, den)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sets = [shingles(t, known, k) for t in batch.column(1).to_pylist()]
                keys = [keys_of(s, labels) for s in sets]
                sig = [_signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([x[0] for x in sig], pa.int64()), pa.array([x[1] for x in sig], pa.int64()),
                     _lists([x[0] for x in keys]), _lists([x[1] for x in keys])],
                    names=["doc_id", "text_hash", "n", "s1", "s2", "light", "heavy"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       text_hash(text_col).alias("text_hash")).mapInArrow(
        run, f"doc_id {kind}, text_hash long, n long, s1 long, s2 long, light array<long>, heavy array<long>")
    keyed = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "set-keys")
    return materialise(keyed.drop("light", "heavy"), "sets"), keyed


def shingle_table(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Stored ``uid, n, items, sketch`` of the wanted classes (uid, own = a document's
    id and text hash, s1, s2)."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                    text_hash(text_col).alias("text_hash"))
    x = x.join(wanted, x["doc_id"].eqNullSafe(wanted["own.doc_id"]) & (x["text_hash"] == wanted["own.text_hash"])).select("uid", "s1", "s2", "text")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                uids, s1, s2, texts = (batch.column(i).to_pylist() for i in range(4))
                sets = [shingles(t, known, k) for t in texts]
                # only if the text hash is that of two texts of a document id
                good = [i for i, s in enumerate(sets) if _signature(s) == (s1[i], s2[i])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uids[i] for i in good], pa.int64()), pa.array([len(sets[i]) for i in good], pa.int64()),
                     _lists([sets[i] for i in good]), _lists([_sketch(sets[i]) for i in good])],
                    names=["uid", "n", "items", "sketch"])

    return materialise(x.mapInArrow(run, "uid long, n long, items array<long>, sketch array<long>"), "set-items")


def _met(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, set): the sets that share a key with another set, and one row a key."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    key, owner = pairs[:, 0], pairs[:, 1]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    shared = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
    sizes = np.diff(np.r_[starts, len(key)])
    return np.unique(owner[np.repeat(shared, sizes)]), pairs[starts]


def sharing_sets(sets: DataFrame, keys: str = "heavy") -> DataFrame:
    """``s1`` of the sets that share a key with a different set. Tasks find the meetings among
    their own rows and send one row a key on (so a frequent key sends one row a task), packed
    by key bucket; a bucket holds about ``BUCKET_KEYS`` keys at any size of the input."""
    total = sets.agg(F.sum(F.size(keys))).first()[0] or 0
    buckets = int(total // BUCKET_KEYS) + 1

    @giving_back
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            if not n:
                return
            pairs = np.concatenate(held)
            held.clear()
            met, rest = _met(pairs)
            del pairs
            for kind, rows, by in ((0, rest, rest[:, 0] if len(rest) else rest), (1, met, met)):
                if len(rows) == 0:
                    continue
                bucket = (by.view(np.uint64) if by.flags.c_contiguous else by.copy().view(np.uint64)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                rows, bucket = rows[order], bucket[order].astype(np.int64)
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[starts[1:], len(rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[starts], pa.int64()), pa.array([kind] * len(starts), pa.int32()),
                     pa.array([rows[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                    names=["bucket", "kind", "data"])

        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                lists = batch.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False),
                                  pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
                held.append(np.column_stack([flat, owner]))
                n += len(flat)
                if n > 2 * BUCKET_KEYS:
                    yield from flush()
                    held, n = [], 0
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        rows = np.frombuffer(b"".join(d for k, d in zip(kinds, data) if k == 0), dtype=np.int64).reshape(-1, 2)
        done = np.frombuffer(b"".join(d for k, d in zip(kinds, data) if k == 1), dtype=np.int64)
        del data
        met = _met(rows)[0] if len(rows) else rows[:, 0]
        out = pa.table({"s1": np.unique(np.concatenate([met, done]))})
        del rows, done, met
        give_back()
        return out

    packed = sets.select("s1", keys).filter(F.size(keys) > 0).mapInArrow(send, "bucket long, kind int, data binary")
    return packed.groupBy("bucket").applyInArrow(meet, "s1 long").distinct()


# ---- the join ------------------------------------------------------------------------

class JaccardJoin:
    def __init__(self, k: int = 3, num: int = 90, den: int = 100):
        self.k, self.num, self.den = k, num, den

    def overlap(self, na: Column, nb: Column) -> Column:
        """Smallest intersection of linked sets of these sizes."""
        return F.ceil(self.num * (na + nb) / (self.num + self.den) - 1e-9)

    def lists(self, docs: DataFrame, keyed: DataFrame, classes: DataFrame, id_col: str, text_col: str):
        """Stored lists (grp, kind, uid, n, shared) and the shingle table behind them; ``keyed`` is deleted."""
        light = keyed.select("s1", "n", F.explode("light").alias("key"))
        met = lambda x: x.groupBy(F.col("key").alias("k")).agg(
            F.min("s1").alias("a"), F.max("s1").alias("b")).filter("a <> b").select("k")
        in_light = materialise(light.join(met(light), F.col("key") == F.col("k"), "left_semi")
                               .select("key", "s1").distinct(), "light-keys")
        in_heavy = materialise(sharing_sets(keyed), "heavy-sets")
        discard(keyed)
        release(docs.sparkSession)
        ids = in_light.select("s1").unionByName(in_heavy).distinct()
        wanted = classes.join(ids, "s1", "left_semi").select("uid", "own", "s1", "s2")
        items = shingle_table(docs, wanted, self.k, id_col, text_col)
        release(docs.sparkSession)
        # heavy: rarest-first prefixes
        big = items.join(classes.join(in_heavy, "s1", "left_semi").select("uid"), "uid", "left_semi")
        tokens = big.select("uid", "n", F.explode("items").alias("tok"))
        df = materialise(tokens.groupBy(F.col("tok").alias("t")).agg(F.count(F.lit(1)).alias("df")).filter("df > 1"),
                         "set-counts")
        release(docs.sparkSession)
        own = Window.partitionBy("uid")
        shared = tokens.join(df, F.col("tok") == F.col("t")).select("uid", "n", "tok", "df")
        shared = shared.withColumn("shared", F.count(F.lit(1)).over(own)) \
            .withColumn("at", F.row_number().over(own.orderBy("df", "tok")))
        least = F.ceil(F.col("n") * self.num / self.den - 1e-9)
        prefix = shared.filter(F.col("at") <= F.col("shared") - least + 1) \
            .select(F.col("tok").alias("grp"), F.lit(1).alias("kind"), "uid", "n", "shared", "at")
        # light: groups of two equal cells
        small = in_light.join(classes.select("s1", "uid", "n"), "s1").select(
            F.col("key").alias("grp"), F.lit(0).alias("kind"), "uid", "n", F.col("n").alias("shared"),
            F.lit(1).alias("at"))
        return materialise(prefix.unionByName(small), "lists"), items

    def can_link(self, a: str, b: str) -> Column:
        """Sizes allow a link, and so do the shingles from this list's on, were it the first
        common one (for linked sets it is, in one of their lists)."""
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        sizes = (self.den * F.least(na, nb)) >= (self.num * F.greatest(na, nb))
        rest = F.least(*[F.col(f"{x}.shared") - F.col(f"{x}.at") + 1 for x in (a, b)])
        return sizes & (rest >= self.overlap(na, nb))

    def near(self, pairs: DataFrame, items: DataFrame) -> DataFrame:
        """Stored pairs (a, b) without those whose sketches alone rule a link out: sets differ in at
        least as many shingles as their parities do, and linked sets of na and nb shingles in at
        most (na + nb) * (den - num) / (den + num)."""
        for x in ("a", "b"):
            pairs = pairs.join(items.select(F.col("uid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")), x)
        apart = sum(F.bit_count(F.col("ka")[i].bitwiseXOR(F.col("kb")[i])) for i in range(SKETCH_WORDS))
        may = apart * (self.num + self.den) <= (F.col("na") + F.col("nb")) * (self.den - self.num)
        return materialise(pairs.filter(may).select("a", "b"), "near-pairs")

    def verify(self, pairs: DataFrame, items: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are linked, by their whole shingle sets."""
        pairs = self.near(pairs, items)
        release(items.sparkSession)
        # only sets of a pair move
        side = lambda x: items.select(F.col("uid").alias(x), F.col("items").alias(f"i{x}")).join(
            pairs.select(x), x, "left_semi")
        x = pairs.join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("ia", "ib"))
        x = x.select("a", "b", common.alias("i"), (F.size("ia") + F.size("ib") - common).alias("u"))
        return materialise(x.filter(self.den * F.col("i") >= self.num * F.col("u")).select("a", "b").distinct(), "links")

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, text_hash, n_shingles, component_id, first``; ``first`` is the component's document
        (smallest doc_id, a null one last; then text hash), null for a document without words."""
        prepare(docs.sparkSession)
        sets, keyed = set_table(docs, self.k, self.num, self.den, id_col, text_col)
        classes = materialise(sets.filter("n > 0").groupBy("s1", "s2").agg(
            F.min("rid").alias("uid"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("own"), F.first("n").alias("n")), "classes")
        lists, items = self.lists(docs, keyed, classes, id_col, text_col)
        release(docs.sparkSession)
        # round 1: every member against its list's centre
        centre = lists.groupBy("kind", "grp").agg(F.min(F.struct(
            (F.col("n") - F.col("shared")).alias("own"), "uid", "n", "shared", "at")).alias("c"), F.count(F.lit(1)).alias("m"))
        centre = centre.filter("m > 1").select("kind", "grp", "c.uid", "c.n", "c.shared", "c.at").alias("c")
        x = lists.alias("l").join(centre, (F.col("l.kind") == F.col("c.kind")) & (F.col("l.grp") == F.col("c.grp"))
                                  & (F.col("l.uid") != F.col("c.uid")) & self.can_link("l", "c"))
        tried = materialise(x.select(F.least("l.uid", "c.uid").alias("a"), F.greatest("l.uid", "c.uid").alias("b"))
                            .distinct(), "pairs")
        links = self.verify(tried, items)
        comps = connected_components(links)
        # round 2: pairs of a list in different components
        x = lists.join(comps, F.col("uid") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "uid"))
        mixed = x.groupBy(F.col("kind").alias("k"), F.col("grp").alias("g")).agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("k", "g")
        x = materialise(x.join(mixed, (F.col("kind") == F.col("k")) & (F.col("grp") == F.col("g")), "left_semi")
                        .select("kind", "grp", "uid", "n", "shared", "at", "comp"), "open-lists")
        cross = x.alias("p").join(x.alias("q"), (F.col("p.kind") == F.col("q.kind")) & (F.col("p.grp") == F.col("q.grp"))
                                  & (F.col("p.uid") < F.col("q.uid")) & (F.col("p.comp") != F.col("q.comp"))
                                  & self.can_link("p", "q"))
        cross = cross.select(F.col("p.uid").alias("a"), F.col("q.uid").alias("b")).distinct().join(
            tried, ["a", "b"], "left_anti")
        links = links.unionByName(self.verify(cross, items))
        comps = connected_components(links)
        # back to documents
        of = classes.join(comps, F.col("uid") == F.col("node"), "left").select(
            F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("comp", "uid").alias("comp"), "own")
        low = of.groupBy(F.col("comp").alias("low")).agg(F.min("own").alias("first"))
        of = of.join(low, F.col("comp") == F.col("low")).select("c1", "c2", "first")
        out = sets.join(of, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") > 0), "left")
        return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "rid", "first",
                          F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))

    def keep_one(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with only the smallest doc_id of every component, and of its texts one
        (documents without words are kept; rows of equal doc_id and text are one). A null doc_id
        names no document: such rows are told apart by their texts."""
        found = self.components(docs, id_col, text_col)
        first = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_hash") == F.col("first.text_hash"))
        kept = found.filter((F.col("n_shingles") == 0) | first).select(
            F.col("doc_id").alias("__keep"), F.col("text_hash").alias("__keep_hash")).distinct()
        x = docs.withColumn("__hash", text_hash(text_col))
        x = x.join(kept, x[id_col].eqNullSafe(kept["__keep"]) & (x["__hash"] == kept["__keep_hash"]), "left_semi")
        return x.dropDuplicates([id_col, "__hash"]).drop("__hash")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id")
