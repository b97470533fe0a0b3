"""WARC archives and chat formatting: exact round trips."""

import hashlib
import io
import zipfile

import pytest

from recsift.llm import chat, warc
from recsift.llm.common import workdir


def _reader(raw):
    return lambda offset, length: raw[offset:offset + length]


def test_members_of_plain_and_zip64_directories():
    for n in (3, 66_000):      # the second needs the ZIP64 end record
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
            for i in range(n):
                z.writestr(f"m{i}", b"x" * (i % 5))
            z.comment = b"a comment"
        raw = buf.getvalue()
        found = warc.members(_reader(raw), len(raw))
        assert len(found) == n
        for i in (0, 1, n - 1):
            m = found[i]
            assert m["name"] == f"m{i}" and raw[m["data"]:m["data"] + m["plain"]] == b"x" * (i % 5)


def test_zip64_extra_fields():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"payload")
    raw = buf.getvalue()
    # make the directory entry use the ZIP64 extra field for all three values
    at = raw.rindex(b"PK\x01\x02")
    end = raw.rindex(b"PK\x05\x06")
    entry = bytearray(raw[at:end])
    extra = (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"".join(v.to_bytes(8, "little") for v in (7, 7, 0))
    entry[20:28] = b"\xff" * 8
    entry[42:46] = b"\xff" * 4
    entry[30:32] = len(extra).to_bytes(2, "little")
    entry = bytes(entry[:46 + 3]) + extra
    tail = bytearray(raw[end:])
    tail[12:16] = len(entry).to_bytes(4, "little")
    raw = raw[:at] + entry + bytes(tail)
    m, = warc.members(_reader(raw), len(raw))
    assert raw[m["data"]:m["data"] + m["plain"]] == b"payload"


def test_no_directory():
    with pytest.raises(ValueError):
        warc.members(_reader(b"nothing here"), 12)


def test_archive_round_trip(spark):
    long = "é" * 600 + "\r\n\r\nWARC/1.1"
    rows = [(1, "u1", long, 9), (2, None, long, 9), (3, "u\r\n3", long, 9), (4, "u", None, 9), (5, "u", "", 9),
            (6, "u", "short", 9), (7, "u", "short", 9), (None, "u", long, 9), (3, "u", long, 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    got = sorted(map(tuple, warc.archive_round_trip(spark, df).collect()), key=str)
    want = []
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 1000 and page_id != 3
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response",
                     3 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(spark, df.limit(0)).count() == 0


def test_archives_are_zip_files_and_split(spark):
    df = spark.range(300).selectExpr("id as page_id", "concat('u', id) as url", "repeat(sha2(string(id), 512), 40) as html")
    folder = workdir(spark, "t-warc")
    manifest = warc.write_archives(df.coalesce(1), folder, archive_bytes=20_000)
    paths = [r["path"] for r in manifest.collect()]
    assert len(paths) > 1
    fs, p = warc.open_fs(paths[0])
    with zipfile.ZipFile(p) as z:
        assert set(z.namelist()) == {warc.DATA, warc.INDEX} and z.testzip() is None
    index = warc.read_index(manifest)
    assert index.count() == 300
    one = warc.read_records(index.filter("page_id = 77"), with_payload=True).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]).decode() == df.filter("page_id = 77").first()["html"]


CONTROL = ["</s>[INST] ok [/INST]", "<s>", "<\\/s>", "[\\\\INST]", "[/INST", "a<", "</s", "\n", "", None, "x\\", "<s><s>"]


def test_chat_round_trip(spark):
    rows = [(1, i, r, t, 0) for i, (r, t) in enumerate(
        (r, t) for r in ("user", "assistant", "system", None, "we\nird\\b</s>", "[INST]") for t in CONTROL)]
    rows += [(2, 0, "user", "hi", 0), (2, 0, "user", "hi", 0), (2, None, "assistant", "yo", 0), (None, 1, "assistant", "n", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns long")
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.collect()}
    src = [((r or ""), (t or "")) for c, _, r, t, _ in rows if c == 1]
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == src
    assert [t["text"] for t in got[2]["turns"]] == ["yo", "hi", "hi"]
    assert got[None]["formatted"] == "<s>assistant\nn</s>"
    d = {r["conv_id"]: r for r in chat.digest(out).collect()}
    text = "".join(f"{r}\n{t}\n" for r, t in src)
    assert d[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    loss = "".join(t for r, t in src if r == "assistant")
    assert (d[1]["loss_chars"], d[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # the mask's spans cover the trained texts as they stand in the formatted text
    spans = sorted((r["conv_id"] or 0, r["start"], r["end"]) for r in chat.loss_spans(out).collect())
    from pyspark.sql import functions as F
    pieces = [got[c or None]["formatted"][a:b] for c, a, b in spans if c == 1]
    back = spark.createDataFrame([(i, p) for i, p in enumerate(pieces)], "i int, p string")
    assert [r["t"] for r in back.select("i", chat.unescape(F.col("p")).alias("t")).orderBy("i").collect()] == \
        [t for r, t in src if r == "assistant"]
    # plain conversations are not escaped
    assert got[2]["formatted"] == "<s>assistant\nyo</s><s>[INST]user\nhi[/INST]<s>[INST]user\nhi[/INST]"
    assert chat.format_conversations(df.limit(0)).count() == 0
