"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 values of the
text's shingles (repeats included). Two fingerprints link at ``DISTANCE`` (2) or fewer
differing bits. They are cut into two segments of 32 bits, fewer than the three a search for
equal segments needs: of two linked fingerprints one segment differs by at most one bit.

*Index.* Fingerprints with the same segment are a class. Each class of a segment enters the
index under its 32 one-wildcard variants (the segment without bit p, and p): an entry meets
the only class that differs from it in bit p and nothing else. Linked fingerprints lie in the
same class or in two classes that meet; candidates come from an equality join on the class and
are verified by the number of differing bits.

*Crowded classes.* Verifying n fingerprints of a class costs n(n - 1) / 2 pairs. Beyond
``PAIRS`` of them a fingerprint is cheaper to find under variants with a second wildcard: two in
the other segment when the class agrees, or bit p and one of the other segment when two
classes meet. Everything under such a key agrees in 62 bits, at most four fingerprints, all
linked: no pair is verified, and the work is linear in the size of the class.

Equal fingerprints are one node, components are found by alternating stars (:mod:`.components`).

Defined cases: null or empty text, or text without words: fingerprint zero, linked like any
other; fewer than ``k`` words: the whole sequence is the only shingle; one result row per input
row, repeated rows included; a null doc_id is never a component's smallest id (a component of null ids
only has a null one); an empty table gives an empty result; other columns are ignored. Long
texts are hashed in blocks of ``BLOCK_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

DISTANCE = 2
SEGMENT_BITS = 32
SEGMENT_MASK = (1 << SEGMENT_BITS) - 1
SEED = 42
PAIRS = 64             # members of a class, or pairs a member of two classes, that are verified directly
BLOCK_BYTES = 1 << 20
HASHES = 1 << 14       # hashes whose bits are counted at once


# ---- fingerprints ----------------------------------------------------------------

def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of an A-Z-lowered text, about ``BLOCK_BYTES`` at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK_BYTES)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].lower().split()     # bytes: A-Z and \x09-\x0D, \x20 only
        at = end


def _hash_words(words: list[bytes], k: int) -> list[int]:
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())]


def fingerprint(text: bytes, k: int = 3) -> int:
    """The 64-bit fingerprint of a text, as a signed integer."""
    ones, n, carried = np.zeros(64, np.int64), 0, []
    for block in _blocks(text):
        words = carried + block
        hashes = _hash_words(words, k) if len(words) >= k else []
        for i in range(0, len(hashes), HASHES):
            part = np.array(hashes[i:i + HASHES], np.dtype("<u8")).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        carried = words[-(k - 1):] if k > 1 else []
    if n == 0 and carried:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(carried), SEED)).astype(np.int64))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row (fp: the fingerprint as a signed long)."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [fingerprint(t.as_buffer().to_pybytes(), k) for t in texts], pa.int64())], names=["doc_id", "fp"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, fp long")


# ---- index -----------------------------------------------------------------------

def _segment(fp: Column, seg: Column) -> Column:
    return F.when(seg == 0, F.shiftrightunsigned(fp, SEGMENT_BITS)).otherwise(fp).bitwiseAND(F.lit(SEGMENT_MASK))


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), p)


def segments(fps: DataFrame) -> DataFrame:
    """``fp, seg, half``: both segments of every fingerprint."""
    x = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg"))
    return x.select("fp", "seg", _segment(F.col("fp"), F.col("seg")).alias("half"))


def classes_of(halves: DataFrame) -> DataFrame:
    """``seg, half, n``: distinct segments and the number of their fingerprints."""
    return halves.groupBy("seg", "half").agg(F.count(F.lit(1)).alias("n"))


def meeting_classes(classes: DataFrame) -> DataFrame:
    """``seg, p, h0, h1, n0, n1``: pairs of classes that differ in bit p of their segment
    only, by the equality of their one-wildcard variants."""
    v = classes.select("seg", "half", "n", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))).alias("p"))
    bit = _bit(F.col("p"))
    one = F.col("half").bitwiseAND(bit) != 0
    v = v.select("seg", "p", (F.col("half") - F.when(one, bit).otherwise(F.lit(0))).alias("h0"),
                 F.when(one, F.lit(None)).otherwise(F.col("n")).alias("n0"), F.when(one, F.col("n")).alias("n1"))
    met = v.groupBy("seg", "p", "h0").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1")).filter("n0 is not null and n1 is not null")
    return met.select("seg", "p", "h0", (F.col("h0") + _bit(F.col("p"))).alias("h1"), "n0", "n1")


def _few(n0: Column, n1: Column) -> Column:
    """Verifying all pairs of two classes costs at most ``PAIRS`` a member."""
    return n0 * n1 <= PAIRS * (n0 + n1)


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def _of_class(halves: DataFrame, suffix: str) -> DataFrame:
    return halves.select(F.col("fp").alias(f"fp{suffix}"), F.col("seg").alias(f"seg{suffix}"), F.col("half").alias(f"half{suffix}"))


def _direct_links(halves: DataFrame, classes: DataFrame, met: DataFrame) -> DataFrame:
    """Verified links within small classes and between small classes that meet."""
    small = classes.filter(F.col("n").between(2, PAIRS)).select("seg", "half")
    own = halves.join(small, ["seg", "half"], "left_semi")
    a, b = _of_class(own, "_a"), _of_class(own, "_b")
    within = a.join(b, (F.col("seg_a") == F.col("seg_b")) & (F.col("half_a") == F.col("half_b")) & (F.col("fp_a") < F.col("fp_b"))
                    & _close("fp_a", "fp_b")).select("fp_a", "fp_b")
    few = met.filter(_few(F.col("n0"), F.col("n1"))).select("seg", "h0", "h1")
    a, b = _of_class(halves, "_a"), _of_class(halves, "_b")
    between = few.join(a, (F.col("seg") == F.col("seg_a")) & (F.col("h0") == F.col("half_a"))) \
        .join(b, (F.col("seg") == F.col("seg_b")) & (F.col("h1") == F.col("half_b")) & _close("fp_a", "fp_b"))
    return within.unionByName(between.select("fp_a", "fp_b"))


def _keyed(x: DataFrame, first: Column, second: Column) -> DataFrame:
    """``fp`` under the key of two wildcards: their places and the other 62 bits."""
    rest = F.col("fp").bitwiseAND(F.bitwise_not(_bit(first).bitwiseOR(_bit(second))))
    return x.select("fp", (F.least(first, second) * 64 + F.greatest(first, second)).alias("wild"), rest.alias("rest"))


def _crowded_links(halves: DataFrame, classes: DataFrame, met: DataFrame) -> DataFrame:
    """Links within crowded classes and between crowded classes that meet, by two wildcards."""
    # segment 0 holds the upper 32 bits of a fingerprint
    own_base = F.when(F.col("seg") == 0, SEGMENT_BITS).otherwise(0)
    other_base = F.lit(SEGMENT_BITS) - own_base
    crowd = classes.filter(F.col("n") > PAIRS).select("seg", "half")
    places = F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))
    own = halves.join(crowd, ["seg", "half"], "left_semi").select("seg", "fp", F.explode(places).alias("i"))
    own = own.select("seg", "fp", "i", F.explode(places).alias("j")).filter("i < j")
    within = _keyed(own, F.col("i") + other_base, F.col("j") + other_base)
    many = met.filter(~_few(F.col("n0"), F.col("n1"))).select("seg", "p", F.explode(F.array("h0", "h1")).alias("half"))
    two = halves.join(many, ["seg", "half"]).select("seg", "fp", "p", F.explode(places).alias("j"))
    between = _keyed(two, F.col("p") + own_base, F.col("j") + other_base)
    # at most four fingerprints share 62 bits
    met4 = within.unionByName(between).groupBy("wild", "rest").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return met4.select(F.array_min("fps").alias("fp_a"), F.explode("fps").alias("fp_b")).filter("fp_a <> fp_b")


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links between the distinct fingerprints of ``fps`` (fp) that give the
    components of all pairs at ``DISTANCE`` or fewer bits."""
    halves = segments(fps)
    classes = materialise(classes_of(halves), "simhash-classes")
    met = materialise(meeting_classes(classes), "simhash-meeting")
    found = _direct_links(halves, classes, met).unionByName(_crowded_links(halves, classes, met))
    return found.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``, one row per row of ``docs``."""
    rows = materialise(fingerprints(docs, id_col, text_col, k), "simhash")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    comps = connected_components(links(fps), "simhash-components").withColumnRenamed("node", "fp")
    linked = materialise(comps.join(fps, "fp"), "simhash-linked")
    smallest = linked.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "comp").select("fp", "component_id")
    own = fps.join(named.withColumnRenamed("fp", "l_fp"), F.col("fp") == F.col("l_fp"), "left").select(
        F.col("fp").alias("c_fp"), F.when(F.col("l_fp").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(own, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id")


def digest(x: DataFrame) -> DataFrame:
    return x.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
