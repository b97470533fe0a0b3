"""Fill-in-the-middle transformation by piece tables.

A document is a table of descriptors (buffer, start, length) over two immutable buffers: its
own text in UTF-8 and the sentinels ``<P><S><M>``. Cutting splits a descriptor at a token's
start and copies nothing; a form (``psm``, ``spm``) is a permutation of the descriptors of
prefix, middle, suffix and the three sentinels; the inverse permutation restores the document.
Hashes and texts are streamed from the descriptors.

Tokens are ``[A-Za-z]+|[^A-Za-z]`` over code points; the cuts and the form come from the hex
SHA-256 of ``seed:doc_id``, so every executor, and every repeated task, decides alike.

Defined cases: null text is empty; an empty text and one that holds a sentinel stay plain (one
descriptor, no cuts); a null doc_id is hashed as an empty string; one result row per input row,
repeated rows and ids included; an empty table gives an empty result; other columns are
ignored, whatever their names. A row costs one byte of scratch memory per byte of text, and
rows leave in groups of at most ``GROUP_BYTES`` of text (or one longer text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT, SENTINELS = 0, 1            # the two buffers
SENTINEL = b"<P><S><M>"
MARKS = (b"<P>", b"<S>", b"<M>")
FIM_PERCENT, SPM_PERCENT = 90, 20
GROUP_BYTES, GROUP_ROWS = 8 << 20, 2000
COUNT_BLOCK = 1 << 14

# Places 0-2 are prefix, middle and suffix, 3-5 the sentinels; a form lists them in output order.
ORDER = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}

Piece = tuple[int, int, int]


def token_starts(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes of a UTF-8 text at which a token starts."""
    lower = data | 0x20
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts


class Tokens:
    """Number of tokens of a text and the byte at which its k-th token starts."""

    def __init__(self, data: np.ndarray):
        self.starts = token_starts(data)
        blocks = np.add.reduceat(self.starts, np.arange(0, len(data), COUNT_BLOCK), dtype=np.int64) if len(data) else []
        self.before = np.r_[0, np.cumsum(blocks)].astype(np.int64)
        self.count = int(self.before[-1])

    def offset(self, k: int) -> int:
        if k >= self.count:
            return len(self.starts)
        block = int(np.searchsorted(self.before, k, "right")) - 1
        at = block * COUNT_BLOCK
        return at + int(np.flatnonzero(self.starts[at:at + COUNT_BLOCK])[k - self.before[block]])


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The table with a descriptor border at place ``at`` of its content."""
    seen = 0
    for i, (buffer, start, length) in enumerate(pieces):
        left = at - seen
        if left <= length:
            return [*pieces[:i], (buffer, start, left), (buffer, start + left, length - left), *pieces[i + 1:]]
        seen += length
    raise ValueError("cut beyond the content")


def arrange(pieces: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix and the sentinels in the order of ``form``."""
    marks = [(SENTINELS, SENTINEL.index(m), len(m)) for m in MARKS]
    return [(pieces + marks)[i] for i in ORDER[form]]


def restore_order(pieces: list[Piece], form: str) -> list[Piece]:
    """The inverse of :func:`arrange`: the document's own descriptors in its order."""
    inverse = np.argsort(ORDER[form])
    return [pieces[i] for i in inverse[:3]]


def parse(output: bytes, form: str) -> list[Piece]:
    """Descriptors over a rendered text: each sentinel and what follows it."""
    marks, at = [], 0
    for place in ORDER[form][::2]:
        at = output.index(MARKS[place - 3], at)
        marks.append(at)
        at += len(MARKS[0])
    ends = [*marks[1:], len(output)]
    return [p for a, e in zip(marks, ends) for p in ((TEXT, a, 3), (TEXT, a + 3, e - a - 3))]


def stream(pieces: Iterable[Piece], buffers) -> Iterator[memoryview]:
    for buffer, start, length in pieces:
        yield memoryview(buffers[buffer])[start:start + length]


def sha256(pieces: Iterable[Piece], buffers) -> str:
    digest = hashlib.sha256()
    for part in stream(pieces, buffers):
        digest.update(part)
    return digest.hexdigest()


def decide(key: str, n: int) -> tuple[int, int, int, int]:
    """First and second cut (in tokens) and the two percentages of a document."""
    h = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b, h3 % 100, h4 % 100


def plan(text, key: str, fim_percent: int, spm_percent: int) -> tuple[int, str, list[Piece], int | None, int | None]:
    """``n, form, descriptors in output order, prefix_chars, middle_chars`` of one document."""
    data = np.frombuffer(text, np.uint8)
    tokens = Tokens(data)
    whole = [(TEXT, 0, len(data))]
    a, b, keep, kind = decide(key, tokens.count)
    raw = bytes(text)
    if not raw or keep >= fim_percent or any(m in raw for m in MARKS):
        return tokens.count, "plain", whole, None, None
    p, m = tokens.offset(a), tokens.offset(b)
    form = "spm" if kind < spm_percent else "psm"
    pieces = cut(cut(whole, p), m)
    chars = lambda lo, hi: int(np.count_nonzero((data[lo:hi] & 0xC0) != 0x80))
    return tokens.count, form, arrange(pieces, form), chars(0, p), chars(p, m)


def _piece_tables(tables: list[list[Piece]]) -> pa.Array:
    flat = [p for t in tables for p in t]
    fields = [pa.field("buffer", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64())]
    values = pa.StructArray.from_arrays([pa.array([p[i] for p in flat], f.type) for i, f in enumerate(fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(t) for t in tables])], pa.int32()), values)


_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, " \
          "pieces array<struct<buffer:int,start:bigint,length:bigint>>, output string, output_sha256 string"


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``GROUP_BYTES`` of ``column`` or one row."""
    size, start = 0, 0
    for i in range(batch.num_rows):
        value = batch.column(column)[i]
        own = value.as_buffer().size if value.is_valid else 0
        if i > start and (size + own > GROUP_BYTES or i - start >= GROUP_ROWS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += own
    if batch.num_rows > start:
        yield batch.slice(start)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, pieces, output, output_sha256``: every
    document's tokens, descriptors (byte ranges) in output order and rendered text."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                    F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, 1):
                cols: list[list] = [[] for _ in range(7)]
                for i in range(part.num_rows):
                    text = part.column(1)[i].as_buffer()
                    n, form, pieces, prefix, middle = plan(text, part.column(2)[i].as_py(), fim_percent, spm_percent)
                    buffers = (text, SENTINEL)
                    row = (n, form, prefix, middle, pieces, b"".join(stream(pieces, buffers)), sha256(pieces, buffers))
                    for col, value in zip(cols, row):
                        col.append(value)
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), None, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(_piece_tables(c) if t is None else pa.array(c, t) for c, t in zip(cols, types))],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"])

    id_type = x.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(run, f"doc_id {id_type}, {_SCHEMA}")


def restore(x: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``x`` without the output, with ``restored`` (the document rebuilt from output and form
    alone) and ``restored_sha256``."""
    keep = [c for c in x.columns if c not in (output_col, "restored", "restored_sha256")]
    y = x.select(*keep, F.col(form_col).alias("__form"), F.col(output_col).alias("__output"))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, at + 1):
                texts, hashes = [], []
                for i in range(part.num_rows):
                    form, value = part.column(at)[i].as_py(), part.column(at + 1)[i].as_buffer()
                    output = value.to_pybytes()
                    pieces = [(TEXT, 0, len(output))] if form == "plain" else restore_order(parse(output, form), form)
                    texts.append(b"".join(stream(pieces, (output,))))
                    hashes.append(sha256(pieces, (output,)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), pa.array(texts, pa.string()),
                                                  pa.array(hashes, pa.string())], names=[*keep, "restored", "restored_sha256"])

    schema = ", ".join(f"`{c}` {y.schema[c].dataType.simpleString()}" for c in keep)
    return y.mapInArrow(run, f"{schema}, restored string, restored_sha256 string")


def digest(x: DataFrame) -> DataFrame:
    """Contract columns of :func:`restore` over :func:`transform`."""
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
