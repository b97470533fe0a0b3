"""Jaccard join, packing, language and toxicity models, the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsift.llm import jaccard, langid, packing, toxicity
from recsift.llm.components import connected_components
from recsift.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def _sets(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def _brute(docs, num, den, k=3):
    sets = [_sets(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and den * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low.setdefault(find(i), []).append(d)
    return {d: (len(sets[i]), min(low[find(i)]) if sets[i] else d) for i, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("num,den,k", [(90, 100, 3), (80, 100, 5)])
def test_jaccard_join_is_exact(spark, num, den, k):
    rng = random.Random(num)
    vocab = [f"w{i}" for i in range(300)]
    docs, passage = [], rng.choices(vocab, k=60)
    for n in (4, 8, 15, 30, 60, 150, 400):
        for _ in range(3):
            base = rng.choices(vocab, k=n)
            for edits in (0, 0, 1, 1, 2, 3, n // 40, n // 25):
                w = list(base)
                for _ in range(edits):
                    op, at = rng.randrange(4), rng.randrange(len(w))
                    if op == 0:
                        w[at] = rng.choice(vocab)
                    elif op == 1:
                        del w[at]
                    elif op == 2:
                        w.append(rng.choice(vocab))
                    elif len(w) > 3:
                        w.pop()
                if rng.random() < 0.3:
                    w += passage
                docs.append((len(docs) * 3 % 1009, " ".join(w)))
    docs = list({d: (d, t) for d, t in docs}.values())
    docs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a B"), (2005, "a")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(5)
    found = jaccard.JaccardJoin(k, num, den).components(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == _brute(docs, num, den, k)


def test_jaccard_join_edge_rows(spark):
    schema = "doc_id long, text string"
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, jaccard.digest(jaccard.JaccardJoin().components(df)).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (None, 1, None), (None, 0, None)], key=str)
    assert jaccard.JaccardJoin().components(df.limit(0)).count() == 0
    assert jaccard.JaccardJoin().keep_one(df.filter("doc_id = 7")).count() == 1


def test_keep_one_goes_by_id_and_text(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(None, "a b c d e f"), (None, "u v w x y z"), (None, ""), (None, None), (None, "a b c d e f"),   # unlinked
            (7, "first text of seven here"), (7, "other text of the same id"), (7, "other text of the same id"),
            (1, base), (9, base + " w40"), (9, "nine has a text of its own"), (None, base)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    out = jaccard.JaccardJoin().keep_one(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted({r for r in rows if r not in ((9, base + " w40"), (None, base))}, key=str)
    # a component of null ids only keeps one of its texts, whatever else has no id
    nulls = spark.createDataFrame([(None, base), (None, base + " w40"), (None, "x y z a b")], "doc_id long, text string")
    assert sorted(r["text"] in (base, base + " w40") for r in jaccard.JaccardJoin().keep_one(nulls).collect()) == [False, True]


def test_sketches_rule_out_near_misses_and_no_link(spark):
    """Copies of one unseen base with a few random edits: nearly all pairs are near misses."""
    rng = random.Random(5)
    vocab, known, join = [f"w{i}" for i in range(5000)], jaccard._Words(), jaccard.JaccardJoin()
    base, sets = rng.choices(vocab, k=200), []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(200), 4 if i % 6 else 1):
            w[at] = rng.choice(vocab)
        sets.append(jaccard.shingles(" ".join(w), known, 3))
    signed = lambda a: a.view(np.int64).tolist()
    items = spark.createDataFrame([(i, len(s), signed(s), signed(jaccard._sketch(s))) for i, s in enumerate(sets)],
                                  "uid long, n long, items array<long>, sketch array<long>")
    every = [(a, b) for b in range(60) for a in range(b)]
    near = {(r["a"], r["b"]) for r in join.near(spark.createDataFrame(every, "a long, b long"), items).collect()}
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in every}
    linked = {(a, b) for (a, b), i in both.items() if 100 * i >= 90 * (len(sets[a]) + len(sets[b]) - i)}
    assert linked and linked <= near
    assert len(near - linked) < 0.05 * len(every)


def test_light_and_heavy_labels():
    labels = jaccard.Labels(90, 100)
    kinds = [labels.light(x) for x in range(60)]
    assert kinds[0] and not kinds[-1] and kinds == sorted(kinds, reverse=True)
    # linked sizes lie in the same or neighbouring classes
    for n in range(1, 3000):
        assert labels.class_of(n * 100 // 90) - labels.class_of(n) <= 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want


def _check_plan(histogram, capacity):
    plan, ranks, seqs = packing.packing_plan(dict(histogram), capacity), {}, {}
    for length, first, n, per, seq, offset in plan:
        for q in range(n):
            ranks.setdefault(length, []).append(first + q)
            seqs.setdefault(seq + q // per, []).append((offset + q % per * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packing_plan():
    rng = np.random.default_rng(0)
    for n in (1, 7, 300, 5000):
        x = np.clip(rng.lognormal(6.3, 1.2, n).astype(int), 1, 4096)
        histogram = dict(zip(*(a.tolist() for a in np.unique(x, return_counts=True))))
        used = _check_plan(histogram, 4096)
        assert used <= max(-(-int(x.sum()) // 4096) * 1.01 + 1, (x > 2048).sum() * 1.01 + 1)
    assert _check_plan({4096: 9, 1: 4096}, 4096) == 10 and _check_plan({}, 4096) == 0
    # best possible is 20: 5 + 3 + 2, 4 + 4 + 2
    assert _check_plan({5: 10, 3: 10, 2: 20, 4: 20}, 10) <= 21


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [(i, t) for i, t in enumerate([None, "", "Hello, World it's ÄÖ\n\n new  lines\t\x1c x", "long words here " * 3000,
                                           "<|endoftext|> Ünï 123", "a b　c é ́"])]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    texts += [(100 + i, r["text"]) for i, r in enumerate(docs)] + [(2, texts[2][1]), (None, "no id")]
    df = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, length int").repartition(3)
    packed = packing.pack_documents(df, tokenizer_path(), keep_ids=True)
    rows = packed.collect()
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    want = []
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, k, s, ids[s:s + 4096]) for k, s in enumerate(range(0, len(ids), 4096))]
    key = lambda x: (str(x[0]), x[1])
    got = sorted(((r["doc_id"], r["piece"], r["start"], list(r["ids"])) for r in rows), key=key)
    assert got == sorted(want, key=key)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    whole = {r["sequence_id"]: list(r["ids"]) for r in packing.assemble(packed).collect()}
    for s, parts in by.items():
        at, ids = 0, []
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            ids += r["ids"]
        assert at <= 4096 and whole[s] == ids
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0


def test_packing_workers_forget_a_task_s_words():
    from recsift.llm import packing
    from recsift.llm.queries import tokenizer_path

    parts = packing.encoder(tokenizer_path(), True)
    before = parts["Wörter,"], parts["<|endoftext|>"]
    assert len(parts) == 2 and parts.words
    parts.forget()
    assert not parts and not parts.words and (parts["Wörter,"], parts["<|endoftext|>"]) == before
    parts.forget()


def test_packing_uses_the_tokenizer_as_loaded(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "!<|startoftext|>!! x<|endoftext|>y", "<|ENDOFTEXT|> <|other|>", "<|endoftext|>",
             "<|endoftext|>" * 20, "one\n<|endoftext|>\ntwo", "plain text."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = Tokenizer.from_file(tokenizer_path())
    want = [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert 49407 in want[0] and 49406 in want[1]
    rows = packing.pack_documents(df, tokenizer_path(), keep_ids=True, added=True).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == dict(enumerate(want))
    staged = {r["doc_id"]: r["ids_crc32"] for r in corpus_pipeline.pack(spark, df, SF).collect()}
    assert staged == {i: zlib.crc32(np.array(w, "<u4").tobytes()) for i, w in enumerate(want)}


def test_language_identification(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(5000, None, "en"), (5001, "", "de"), (5002, "12 %% ²", None), (None, "der die und", None),
                                   (5003, "Die Häuser und der Garten", None)], "doc_id long, text string, lang string")
    both = docs.unionByName(extra).withColumn("score", F.lit("x"))
    out = {r["doc_id"]: r for r in langid.identify(both).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (5000, 5001, 5002))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert sum(out[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.97
    none = langid.identify(both.withColumn("lang", F.lit(None).cast("string")))
    assert none.filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(both.limit(0)).count() == 0


def test_language_filter_has_no_false_negatives():
    langs = [f"l{i}" for i in range(70)]            # two blocks of masks
    masks = np.zeros((2, 1 << 12), dtype=np.uint64)
    for b, word in ((0, "alpha"), (65, "omega")):
        for g in langid.grams_of(word):
            for s in langid.slot_columns(np.array([langid.gram_hash(g)]), 1 << 12):
                masks[b // 62, s] |= np.uint64(1 << (b % 62))
    f = langid.Filter(langs, masks)
    assert f.word_hits("alpha")[1 + 0] == f.word_hits("alpha")[0] and f.word_hits("omega")[1 + 65] == f.word_hits("omega")[0]
    assert f.predict("omega 7 omega")[0] == "l65" and f.predict("ALPHA")[0] == "l0"


def test_language_counts_against_exact_sets(spark):
    """Popcounts of the filter, n-gram by n-gram, and the corrected decision, against plain Python."""
    rng = random.Random(2)
    alphabets = {"aa": "abcdeé", "bb": "defghß", "cc": "漢字仮名😀x"}
    word = lambda k: "".join(rng.choices(alphabets[k], k=rng.randrange(1, 9)))
    rows = [(" ".join(word(k) for _ in range(40)), k) for k in alphabets for _ in range(15)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    words = [word(k) for k in alphabets for _ in range(200)] + ["é" * 500, "q"]
    h, of = langid.gram_hashes(words)
    assert [list(map(int, h[of == i])) for i in range(0, 602, 37)] == [
        [langid.gram_hash(g) for n in langid.SIZES for g in [f" {words[i]} "[j:j + n] for j in range(len(words[i]) + 3 - n)]]
        for i in range(0, 602, 37)]
    slots = model.masks.shape[1]
    single = {}
    for w in words:
        want = [0] * (1 + len(model.langs))
        for g in langid.grams_of(w):
            mask = -1
            for s in langid.slot_columns(np.array([langid.gram_hash(g)]), slots):
                mask &= int(model.masks[0, s[0]])
            for b in range(len(model.langs)):
                want[1 + b] += mask >> b & 1
            want[0] += 1
        single[w] = want
    assert model.hits(words).tolist() == single_rows(single, words)
    texts = [None, "", "12 ²", *(" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(60))]
    langs, scores = model.predict_batch(texts)
    for t, lang, score in zip(texts, langs, scores):
        ws = langid.words_of(t or "")
        if not any(c.isalpha() for w in ws for c in w):
            assert (lang, score) == ("und", 0.0)
            continue
        total = np.sum([single[w] if w in single else model.word_hits(w) for w in ws], axis=0, dtype=float)
        fixed = (total[1:] - total[0] * model.false_rate) / (1 - model.false_rate)
        assert lang == model.langs[int(np.argmax(fixed))] and abs(score - min(max(fixed.max() / total[0], 0), 1)) < 1e-12


def single_rows(single, words):
    return [[float(x) for x in single[w]] for w in words]


def test_language_filter_grows_with_the_ngrams(spark):
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    rows = [(" ".join("".join(rng.choices(letters, k=4)) for _ in range(500)), "zh") for _ in range(100)]
    rows += [("the quick brown fox jumps over a lazy dog", "en")]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    grams = {g for t, _ in rows for w in t.split() for g in langid.grams_of(w)}
    assert len(grams) > 300_000 and model.masks.shape[1] >= langid.SLOTS_PER_GRAM * len(grams)
    assert max(model.false_rate) <= (langid.HASHES / langid.SLOTS_PER_GRAM) ** langid.HASHES
    assert model.predict("a quick dog")[0] == "en"


def test_deobfuscation():
    from collections import Counter

    counts = Counter()
    for w in "loser idiot stupid trash worthless hello running letter moron class the and feed".split():
        for g in toxicity.trigrams(w):
            counts[g] += 20
    lm = toxicity.TrigramModel(dict(counts))
    for raw, want in (("l0s3r", "loser"), ("stuuupid", "stupid"), ("tr@sh!!", "trash"), ("m0r0n###", "moron"), ("w.o.r.t.h.l.e.s.s", "worthless"),
                      ("$tup1d", "stupid"), ("letter", "letter"), ("1234", "1234"), ("cla$$", "class")):
        assert toxicity.restore(raw, lm) == want, raw
    assert "idiot" in toxicity.restore_text("you i d i o t , HELLO", lm).split()


def _language(*texts):
    from collections import Counter

    counts = Counter()
    for w in " ".join(texts).split():
        for g in toxicity.trigrams(w):
            counts[g] += 20
    return toxicity.TrigramModel(dict(counts))


def test_deobfuscation_at_edges_without_letters_long_and_spaced():
    lm = _language("you idiot shit ass are such an the and good will letter as is see this that word hello stupid")
    for raw, want in (("!diot", "idiot"), ("shi+", "shit"), ("1d107", "idiot"), ("a55", "ass"), ("@$$", "ass"), ("idioot", "idiot"),
                      ("i" * 15 + "d" * 8 + "i" * 10 + "o" * 8 + "t" * 4, "idiot"), ("2024", "2024"), ("$4.55", "$4.55"), ("word!", "word"),
                      ("(see", "see"), ("good", "good"), ("will", "will"), ("letter", "letter"), ("\"stupid!!!\"", "stupid")):
        assert toxicity.restore(raw, lm) == want, raw
    for raw, want in (("i d ! o t", "idiot"), ("a s s", "ass"), ("y o u i d i o t", "you idiot"), ("1 2 3 4", "1234"),
                      ("see i-d-i-o-t hello", "see idiot hello")):
        assert toxicity.restore_text(raw, lm) == want, raw
    long = "x0" * 50_000
    assert len(toxicity.restore(long, lm)) > 0      # linear in the token's length


def test_decoding_equals_every_path():
    """Viterbi against the best of all paths of the lattice."""
    from itertools import product

    lm = _language("you idiot shit ass are such an the and good will letter")
    rng = random.Random(9)

    def value(outs, cost):
        context, s, text = "  ", -cost, ""
        for out in outs:
            for c in out:
                if c == " ":
                    s += lm.log_p(context, " ") - toxicity.COST_BREAK
                    context = "  "
                else:
                    s += lm.log_p(context, c)
                    context = context[1] + c
            text += out
        return s + lm.log_p(context, " ")
    for _ in range(60):
        core = "".join(rng.choice("idots105!$+aa.") for _ in range(rng.randrange(1, 6)))
        for spaced in (False, True):
            options = []
            for i in range(len(core)):
                own = toxicity.arcs(core, i, spaced)
                options.append(own + [(o + " ", c) for o, c in own if o and spaced and i + 1 < len(core)])
            best = max(value([o for o, _ in path], sum(c for _, c in path)) for path in product(*options))
            got = toxicity.decode(core, lm, spaced)
            reached = [value([o for o, _ in path], sum(c for _, c in path)) for path in product(*options)
                       if "".join(o for o, _ in path).strip() == got]
            assert max(reached) >= best - 1e-9, (core, spaced)


def test_repeated_letters_path_by_path():
    lm = _language("you idiot shit ass are such an the and good will letter see class")
    rng = random.Random(4)
    for _ in range(500):
        core = "".join(rng.choice("asidotle") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 6)))
        a, b = toxicity.repeats(core, lm), toxicity.decode(core, lm)
        worth = lambda w: lm.word_log_p(w) - toxicity.COST_REPEAT * (len(core) - len(w))
        assert a == b or abs(worth(a) - worth(b)) < 1e-9, core


def test_toxicity_memory_does_not_grow_with_the_input(monkeypatch):
    monkeypatch.setattr(toxicity, "TOKENS", 50)
    monkeypatch.setattr(toxicity, "CONTEXTS", 200)
    scorer = toxicity.Scorer({"abc": 3, " ab": 3}, {"idiot": 3.0})
    rng = random.Random(1)
    for _ in range(300):
        scorer.evidence(" ".join("".join(rng.choices("abcdefgh0135!", k=6)) for _ in range(10)) + " 1d10t")
        assert len(scorer.known) <= 50 and len(scorer.lm.seen) <= 200


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.createDataFrame([(9000, None), (9001, ""), (None, "words")], "doc_id long, text string")
    odd = labels.select("doc_id", "toxic").unionByName(spark.createDataFrame([(9000, None), (77777, 1), (None, 1)], "doc_id long, toxic int"))
    both = docs.unionByName(more)
    model = toxicity.learn(both, odd.unionByName(odd))
    out = {r["doc_id"]: r for r in toxicity.score(both, model, ["doc_id"]).collect()}
    assert len(out) == docs.count() + 3 and all(0 <= r["score"] <= 1 for r in out.values())
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert sum(out[i]["predicted"] == y for i, y in truth.items()) / len(truth) > 0.85
    assert out[9000]["predicted"] == 0 and out[9001]["predicted"] == 0
    none = toxicity.learn(both, odd.limit(0))
    assert toxicity.score(both, none, ["doc_id"]).filter("predicted = 1").count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))
    docs = docs.unionByName(odd)
    from recsift.llm import decontam, linededup
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert out.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "line_dedup":
            want = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
            assert got == want
        if name == "jaccard_join":
            brute = _brute([(r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in docs.collect()], 80, 100, 5)
            assert set(got) == {None if d == -1 else d for d, (n, c) in brute.items() if n == 0 or c == d}
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontam.digest(decontam.scan(docs, bench)).filter("contaminated").collect()}
            assert set(got) == {r["doc_id"] for r in docs.collect()} - bad
        docs = out.checkpoint()
