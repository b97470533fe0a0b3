"""Fill-in-the-middle by piece tables against a plain version."""

import hashlib
import random
import re

from recsift.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_version(doc_id, text):
    text = text or ""
    tok = TOKEN.findall(text)
    n = len(tok)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = "".join(tok[:a]), "".join(tok[a:b]), "".join(tok[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def test_against_plain_version(spark):
    rng = random.Random(5)
    alphabet = ["a", "bC", "Zz", " ", "\n", "é", "漢", "😀", "<", "P", ">", "<S", "\t", "9", " ", "\r\n"]
    texts = [None, "", "<", "a", "<P>", "x<M>y", "<S", "é", "Ab" * 40_000 + "é" * 30_000 + " z" * 50_000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (3, texts[3], "x", 3), (9, "other text", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, pieces int")
    got = fim.digest(fim.restore(fim.transform(df))).collect()
    want = [plain_version(r[0], r[1]) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.digest(fim.restore(fim.transform(df.limit(0)))).count() == 0


def test_pieces_and_texts(spark):
    df = spark.createDataFrame([(i, f"def f{i}(x):\n    return x * {i} # é\n") for i in range(60)], "doc_id long, text string")
    seen = set()
    for r in fim.restore(fim.transform(df)).collect():
        text = f"def f{r['doc_id']}(x):\n    return x * {r['doc_id']} # é\n"
        assert r["restored"] == text
        pieces = [tuple(p) for p in r["pieces"]]
        joined = b"".join(bytes(v) for v in fim.stream(pieces, (text.encode(), fim.SENTINEL)))
        assert hashlib.sha256(joined).hexdigest() == r["output_sha256"]
        seen.add(r["form"])
    assert seen == {"plain", "psm", "spm"}


def test_cut_and_orders():
    table = [(0, 0, 5), (1, 3, 3), (0, 9, 4)]
    for at in range(13):
        got = fim.cut(table, at)
        assert sum(p[2] for p in got) == 12 and len(got) == 4 and sum(p[2] for p in got[:next(
            i for i in range(5) if sum(p[2] for p in got[:i]) == at)]) == at
    own = [(0, 0, 2), (0, 2, 3), (0, 5, 1)]
    for form in fim.ORDER:
        assert fim.restore_order(fim.arrange(own, form), form) == own
