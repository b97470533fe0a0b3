"""Text embedding (D19, X4) and token pooling.

The reference runs a transformer over text batches. Here an encoder is any
callable ``list[str] -> np.ndarray``, run once per Arrow batch in a
pandas UDF (loaded once per worker). The built-in :class:`HashEncoder` is a
feature-hashing stand-in: each token adds ±1 to one of ``dim`` slots. The
same encoder is also available as a pure Column expression
(:func:`hash_vector`) so jobs over short texts stay JVM-side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize

HASH_DIM = 64
TOKEN_PATTERN = r"[^\p{L}\p{N}]+"


def _h32(col: Column) -> Column:
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")


def hash_vector(col: str | Column, dim: int = HASH_DIM, pooling: str = "mean") -> Column:
    """Feature-hashing vector of the whole text as array<double>.

    Slot = md5(token|'dim') mod dim, sign = +1/-1 from md5(token|'sign');
    'sum' adds, 'mean' divides by the token count. O(dim × tokens) per row."""
    c = F.col(col) if isinstance(col, str) else col
    toks = tokenize(c)
    enc = F.transform(toks, lambda t: F.struct(
        F.pmod(_h32(F.concat(t, F.lit("|dim"))), F.lit(dim)).alias("d"),
        (F.lit(1) - F.pmod(_h32(F.concat(t, F.lit("|sign"))), F.lit(2)) * 2).alias("s")))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: F.aggregate(F.filter(enc, lambda e: e["d"] == i), F.lit(0.0),
                                            lambda acc, e: acc + e["s"]))
    if pooling == "mean":
        n = F.greatest(F.size(toks), F.lit(1))
        vec = F.transform(vec, lambda x: x / n)
    return vec


class HashEncoder:
    """NumPy twin of :func:`hash_vector` (same tokens, slots and signs). Texts are taken in runs of
    bounded length; the tokens of a run are dictionary-encoded, each different one is hashed once, and all texts'
    vectors come from one weighted count over (text, slot). ``pooling``: ``'mean'`` or ``'sum'``; a hashed
    text has no first position, so ``'cls'`` is refused."""

    RUN_CHARS = 1 << 20     # characters of a run (a longer text is a run of its own)

    def __init__(self, dim: int = HASH_DIM, pooling: str = "mean"):
        import regex

        if pooling not in ("mean", "sum"):
            raise ValueError(f"feature hashing has no {pooling!r} pooling: tokens have no positions")
        self.dim, self.pooling = dim, pooling
        self._split = regex.compile(TOKEN_PATTERN, regex.V1).split

    def _slots(self, words) -> tuple[np.ndarray, np.ndarray]:
        h = [(int(hashlib.md5((w + "|dim").encode()).hexdigest()[:8], 16), int(hashlib.md5((w + "|sign").encode()).hexdigest()[:8], 16))
             for w in words]
        h = np.array(h, dtype=np.int64).reshape(-1, 2)
        return h[:, 0] % self.dim, 1 - 2 * (h[:, 1] % 2)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.dim))
        start = held = 0
        for i, t in enumerate(texts):
            size = len(t) if t else 0
            if i > start and held + size > self.RUN_CHARS:
                out[start:i] = self._run(texts[start:i])
                start, held = i, 0
            held += size
        out[start:] = self._run(texts[start:])
        return out

    def _run(self, texts: list[str]) -> np.ndarray:
        lists = [list(filter(None, self._split(t))) if t else [] for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), object, int(sizes.sum()))
        if not len(flat):
            return np.zeros((len(texts), self.dim))
        codes, words = pd.factorize(flat)
        slot, sign = self._slots(words)
        place = np.repeat(np.arange(len(texts)) * self.dim, sizes) + slot[codes]
        out = np.bincount(place, weights=sign[codes], minlength=len(texts) * self.dim).reshape(len(texts), self.dim)
        return out / np.maximum(sizes, 1)[:, None] if self.pooling == "mean" else out


_ENCODERS: dict[object, object] = {}   # in a Python worker: encoders by their key


def embed_text(df: DataFrame, col: str, out: str = "embedding",
               encoder_factory: Callable[..., Callable[[list[str]], np.ndarray]] = HashEncoder,
               encoder_key: object = None, pooling: str | None = None, max_len: int | None = None,
               partitions: int | None = None) -> DataFrame:
    """Add ``out`` = encoder(text) as array<double>. The factory runs once per
    Python worker and ``encoder_key`` (default: the factory's name and parameters; name one
    for a lambda); batches arrive through Arrow. ``pooling`` is
    handed to the factory, which refuses what it cannot do; ``max_len`` keeps a text's first so many space-separated tokens,
    as a tokenizer's truncation does. ``partitions`` spreads the rows first, for few large ones."""
    options = {} if pooling is None else {"pooling": pooling}
    key = (encoder_key or f"{encoder_factory.__module__}.{getattr(encoder_factory, '__qualname__', repr(encoder_factory))}",
           tuple(options.items()))

    # not an iterator UDF: a task runs each of those in a Python worker of its own, several plain ones share one
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def enc(s: pd.Series) -> pd.Series:
        from recsift.operators import embed as here

        if key not in here._ENCODERS:
            here._ENCODERS[key] = encoder_factory(**options)
        return pd.Series(list(here._ENCODERS[key](s.tolist())))

    text = F.col(col)
    if max_len is not None:
        text = F.substring_index(text, " ", max_len)
    if partitions is not None:
        df = df.repartition(partitions)
    return df.withColumn(out, enc(text))


def mean_pool(tokens: DataFrame, group: str | list[str], vec: str, weight: str | None = None,
              position: str | None = None, skip_first: bool = False, out: str = "pooled") -> DataFrame:
    """Masked mean of token vectors per sentence (``weight`` = attention
    mask), optionally without the first position. Uses the ``Summarizer``
    aggregate: partial (map-side) aggregation, so no sentence is ever
    collected in one place."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    keys = [group] if isinstance(group, str) else list(group)
    df = tokens
    if skip_first and position:
        df = df.filter(F.col(position) > 0)
    feats = array_to_vector(F.transform(vec, lambda x: x.cast("double")))
    df = df.select(*keys, feats.alias("_f"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    df = df.filter(F.col("_w") > 0)
    agg = df.groupBy(*keys).agg(Summarizer.mean(F.col("_f"), F.col("_w")).alias("_m"))
    return agg.select(*keys, vector_to_array("_m").alias(out))


def mean_of_layers(a: str | Column, b: str | Column) -> Column:
    """A11 variant: element-wise mean of two layers' pooled vectors."""
    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    return F.zip_with(ca, cb, lambda x, y: (x + y) / 2)
