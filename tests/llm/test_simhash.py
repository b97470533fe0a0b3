"""SimHash near-duplicates against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from recsift.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps):
    """Smallest index of each index's component of fingerprints at two or fewer bits."""
    comp = {f: f for f in fps}

    def root(f):
        while comp[f] != f:
            f = comp[f]
        return f
    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                comp[root(a)] = root(b)
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(root(f), i)
    return [first[root(f)] for f in fps]


def test_fingerprints(spark, monkeypatch):
    rng = random.Random(3)
    words = ["The", "cat", "é", "İ", "ẞ", "x" * 30, "a,b", "漢字", "\x1c", "\x85", " z"]
    texts = [None, "", " \t\n", "One", "One two", "one  TWO\tthree", "É one É"] + [
        rng.choice([" ", "\n", "  ", "\x0b"]).join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(80)]
    texts.append(" ".join(rng.choice(words) for _ in range(60_000)))
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id string")
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.digest(
        simhash.fingerprints(df).withColumn("component_id", F.lit(1))).collect()}
    assert got == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(texts)}
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 7)
    monkeypatch.setattr(simhash, "HASHES", 3)
    for t in texts[:60]:
        assert simhash.fingerprint((t or "").encode()) & (1 << 64) - 1 == plain_fingerprint(t)


def family(rng, n, spread):
    """Fingerprints around a few centres, with flips in either or both segments."""
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = []
    for _ in range(n):
        f = rng.choice(centres)
        for _ in range(rng.randrange(spread + 1)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return out


@pytest.mark.parametrize("pairs", [0, 2, 64])
def test_components_against_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(pairs)
    fps = family(rng, 250, 5) + [0, (1 << 64) - 1, 1 << 63, 3, (1 << 63) | 1, 7 << 31] + [rng.getrandbits(64) for _ in range(60)]
    fps += [fps[0]] * 3
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in set(signed)], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)
    comp = {f: f for f in signed}

    def root(f):
        while comp[f] != f:
            f = comp[f]
        return f
    for a, b in found:
        comp[root(a)] = root(b)
    first = {}
    for i, f in enumerate(signed):
        first.setdefault(root(f), i)
    assert [first[root(f)] for f in signed] == plain_components(fps)


def test_crowded_classes_stay_linear(spark, monkeypatch):
    """Fingerprints of one class: the rows that meet grow with the class, not its square."""
    monkeypatch.setattr(simhash, "PAIRS", 8)
    rng = random.Random(1)
    made = {}
    for n in (200, 800):
        low = rng.sample(range(1 << 20), n)
        fps = spark.createDataFrame([((5 << 32) + x,) for x in low], "fp long")
        halves = simhash.segments(fps)
        classes = simhash.classes_of(halves)
        met = simhash.meeting_classes(classes)
        made[n] = simhash._crowded_links(halves, classes, met).count()
        direct = simhash._direct_links(halves, classes, met)
        assert direct.count() <= 8 * n
    assert made[200] <= 2016 * 200 and made[800] <= 2016 * 800


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w7 ", "v7 ")
    rows = [(5, base), (3, base.upper()), (9, near), (None, base), (4, None), (8, ""), (2, " \n"), (1, "quite another text here"),
            (1, "quite another text here"), (None, "alone and without an id")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, comp int")
    out = simhash.digest(simhash.near_duplicates(df)).collect()
    assert len(out) == len(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    least = {c: min([i for (i, _), d in zip(rows, comp) if d == c and i is not None], default=None) for c in comp}
    want = sorted(repr((i, f"{f:016x}", least[c])) for (i, _), f, c in zip(rows, fps, comp))
    assert sorted(repr(tuple(r)) for r in out) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
