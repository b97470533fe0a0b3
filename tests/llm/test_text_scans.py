"""Licence scan, decontamination, line dedup and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from recsift.llm import decontam, fingerprints, licences, linededup
from recsift.llm.fixedvalues import BASE_PHRASES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def test_words(spark):
    from recsift.llm.common import alnum_words

    texts = [None, "", " .,", "Ab-cD 9É é İ ẞ Ⅷ ", "x" * 50_000 + " y", " a  b", "ǅx Ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", alnum_words(F.col("t")).alias("w")).collect()}
    assert [got[i] for i in range(len(texts))] == [words(t) for t in texts]


def test_licences(spark):
    texts = [None, "", "no licence", "Released under the MIT License. mit LICENSE!", "CC-BY 4.0 and CC BY",
             "GNU General Public License GNU General Public License", "the gnu general license",
             "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
             "All rights reserved.", "mit mit license license", "x " * 30_000 + "apache license"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "MIT License", 1), (3, texts[3], 1)],
                               "doc_id long, text string, places int")
    got = licences.digest(licences.scan(df)).collect()
    assert len(got) == len(texts) + 2
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        w = words(t)
        places = [(k, lab) for p, lab in BASE_PHRASES.items() for ph in [p.split()]
                  for k in range(len(w)) if w[k:k + len(ph)] == ph]
        r, starts = by[i], [k for k, _ in places]
        labels = sorted({lab for _, lab in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == \
            (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels)), t
        assert set(labels) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert "cc-by-nc" in by[7]["labels"].split(",") and by[8]["labels"] == "all-rights-reserved" and by[6]["labels"] == ""
    assert by[None]["base_labels"] == "mit"
    assert licences.scan(df.limit(0)).count() == 0


def _brute_hits(text, items, n=10):
    w, hit, ids = words(text), set(), set()
    for item_id, t in items:
        iw = words(t)
        grams = {tuple(iw[i:i + n]) for i in range(max(1, len(iw) - n + 1))} if iw else set()
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    ids.add(item_id)
    return w, hit, ids - {None}


def test_decontamination(spark):
    rng = random.Random(3)
    vocab = ["Aa", "bb", "cc"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 4, 9, 10, 11, 14])))) for i in range(12)]
    items = [(i, t) for i, t in items if len(t.split()) > 3] + [(77, None), (78, ""), (79, "long item"), (None, "zz yy")]
    docs = [(i, ", ".join(rng.choices(vocab, k=rng.choice([0, 3, 12, 60])))) for i in range(25)]
    docs += [(100, None), (101, ""), (102, "see LONG item, long item."), (103, "zz yy"), (None, "long item"), (0, docs[0][1])]
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, hits int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"]): r for r in decontam.digest(decontam.scan(d, b)).collect()}
    for i, t in docs:
        w, hit, ids = _brute_hits(t, items)
        names = ",".join(sorted(map(str, ids)))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == \
            (len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    kept = decontam.remove_documents(d, b)
    assert kept.columns == d.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(
        str(i) for i, t in docs if not _brute_hits(t, items)[1])
    for r in decontam.remove_spans(d, b).collect():
        t = next(t for i, t in docs if i == r["doc_id"])
        w, hit, _ = _brute_hits(t, items)
        assert words(r["text"]) == [x for k, x in enumerate(w) if k not in hit]
        assert (r["text"] is None) == (t is None)
    # the shuffled join gives the same
    old, decontam.BROADCAST_WINDOWS = decontam.BROADCAST_WINDOWS, 0
    try:
        again = {r["doc_id"]: r for r in decontam.digest(decontam.scan(d, b)).collect()}
    finally:
        decontam.BROADCAST_WINDOWS = old
    assert again == got
    none = decontam.digest(decontam.scan(d, b.limit(0)))
    assert none.filter("contaminated").count() == 0 and none.count() == len(docs) - 1
    assert decontam.scan(d.limit(0), b).count() == 0


def test_line_dedup(spark):
    passage = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(60))
    log = "the user logged in as {} from host {} after a long and quiet evening at home"
    docs = [(1, f"alpha own line here\n{passage}\nanother thing of document one"), (2, f"{passage}\nsecond document speaks"),
            (3, log.format("ann", "berlin") + "\nthird"), (4, log.format("bob", "paris") + "\nfourth"),
            (5, log.format(17, "10.1.2.3") + "\nfifth"), (6, "short line here\nsixth own words"), (7, "short line here\nseven"),
            (8, None), (9, ""), (10, "\n\n"), (2, f"{passage}\nsecond document speaks"), (None, passage)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, drop string")
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == len(docs)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[None] == passage                       # a null id comes first
    assert got[1] == "alpha own line here\nanother thing of document one" and got[2] == "second document speaks"
    kept = [i for i in (3, 4, 5) if "logged in" in got[i]]
    assert kept == [3]                                # variable fields are generalised, the first stays
    assert got[6].startswith("short line here") and got[7].startswith("short line here")   # only two documents
    assert got[8] is None and got[9] == "" and got[10] == "\n\n"
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    many = spark.createDataFrame([(i, f"see all rights\nown {'abcdefgh'[i]} tail words") for i in range(6)], "doc_id long, text string")
    assert linededup.dedup_lines(many).filter("text like 'see%'").count() == 1


def test_line_dedup_compares_every_token_of_long_lines(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    long = [word() for _ in range(57)]
    other = long[:3] + [word() for _ in range(54)]             # the leaf's second template
    third = long[:3] + [word() for _ in range(54)]

    def changed(line, *at):
        return " ".join(word() if i in at else w for i, w in enumerate(line))
    near = (5, 20, 33, 40)                                     # 53 of 57 agree
    far = range(3, 17)                                         # 43 of 57 agree
    docs = [(1, changed(long)), (2, changed(long, *near)), (3, changed(long, *far)), (4, changed(other)),
            (5, changed(other, *near)), (6, changed(third, 50, 51)), (7, changed(third, 10, 11, 12, 13, 14)),
            (8, changed(long, 6, 26))]
    df = spark.createDataFrame([(i, f"{line}\nown {word()} {word()} {word()}") for i, line in docs], "doc_id long, text string")
    got = {r["doc_id"]: "\n" not in r["text"] for r in linededup.dedup_lines(df).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 8: True}


def _jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def test_fingerprints_measure_generalised_jaccard(spark):
    rng = random.Random(5)
    base = rng.choices([f"w{i}" for i in range(40)], k=120)
    texts = [" ".join(base)] + [" ".join(base[:120 - 20 * k] + rng.choices([f"v{i}" for i in range(30)], k=20 * k)) for k in (1, 2, 4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    sig = {r["i"]: r["sig"] for r in fingerprints.signatures(df, ["i"], samples=400).collect()}
    for i in (1, 2, 3):
        share = sum(x == y for x, y in zip(sig[0], sig[i])) / 400
        assert abs(share - _jaccard(texts[0], texts[i])) < 0.1


def test_fingerprint_edits(spark):
    docs = [(5, "a b c d e f"), (1, "häuser und gärten im grünen"), (3, None), (4, ""), (9, "a b c d e f"), (12, "one"),
            (12, "one"), (12, "two words")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, rn int")
    got = fingerprints.digest(fingerprints.fingerprint_edits(df)).collect()
    assert len(got) == len(docs) - 1                    # equal rows are one document
    one = [r for r in got if r["doc_id"] != 12]
    order = [(1, docs[1][1]), (3, ""), (4, ""), (5, docs[0][1]), (9, docs[0][1])]
    nexts = {1: "", 3: "", 4: "a b c d e f", 5: "a b c d e f"}
    for r in one:
        text = dict(order)[r["doc_id"]]
        assert r["n_chars"] == len(text)
        if r["doc_id"] in nexts:
            half = len(text) // 2
            edited = text[:len(text) - half] + nexts[r["doc_id"]][:half]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    by = {r["doc_id"]: r for r in one}
    assert by[5]["fingerprint"] == by[9]["fingerprint"] and by[5]["near_next"] == 1.0
    assert by[3]["near_next"] == 1.0 and by[4]["near_next"] == 0.0 and by[3]["fingerprint"] == ""
    assert by[4]["near_edited"] == 1.0
    assert fingerprints.fingerprint_edits(df.limit(0)).count() == 0


def test_decontamination_makes_window_texts_only_for_hits(spark):
    """op10: the broadcast join is by hash alone, no window text is made for its keys; windows of several lengths."""
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30))), (2, "w3 W4, w5"), (3, "w3 w4"), (4, ""), (5, None),
                               (6, "x w3 w4 w5 w3 w4 w5")], "doc_id long, text string")
    b = spark.createDataFrame([("a", "w3 w4 w5"), ("b", " ".join(f"w{i}" for i in range(8, 20))), ("c", "")], "item_id string, text string")
    x = decontam.scan(d, b)
    join = next(p for p in x._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftOuter" in p)
    # the hash is the only equation, and no lambda (which generated code cannot hold) is in the scan
    assert "array_join" in join and "lambda" not in join and join.count(" = ") == 1
    got = {r["doc_id"]: r for r in decontam.digest(x).collect()}
    assert {k: (r["n_words"], r["n_hit"], r["n_items"]) for k, r in got.items()} == {
        1: (30, 15, 2), 2: (3, 3, 1), 3: (2, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0), 6: (7, 6, 1)}


def test_line_dedup_moves_tokens_of_wide_leaves_only(spark, monkeypatch):
    """op7: lines alone in their leaf are dropped before tokens move, and the shuffled form gives the same."""
    rng = random.Random(11)
    rows = [(i, "\n".join([f"user {rng.randint(0, 9)} logged in from host {rng.choice('abc')} at noon sharp today ok",
                           " ".join(rng.choices("pqrstuvw", k=rng.randint(3, 14)))])) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    plans, store = {}, linededup.materialise

    def spy(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, tag)
    monkeypatch.setattr(linededup, "materialise", spy)
    got = sorted(linededup.dedup_lines(d, counts=True).collect())
    below = plans["line-tokens"].split("Aggregate [leaf")[1]
    assert "Join LeftSemi" in below and "strategy=broadcast" in below
    monkeypatch.setattr(linededup, "BROADCAST_LEAVES", -1)
    assert sorted(linededup.dedup_lines(d, counts=True).collect()) == got
    assert sum(r["n_dropped"] for r in got) > 0
