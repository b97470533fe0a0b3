"""Seeded, engine-independent hashing for reproducible sampling.

The reference draws with an unseeded RNG; here every draw is a function of
(key, seed): the first 8 hex digits of md5('k1|k2|...|seed') as an integer.
DuckDB computes the same number as ('0x' || substr(md5(...), 1, 8))::BIGINT.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(cols: Sequence[str | Column], seed: int | str) -> Column:
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.concat_ws("|", *parts, F.lit(str(seed)))


def hash_hex(cols: Sequence[str | Column], seed: int | str) -> Column:
    """md5 hex digest of the seeded key (a uniform sort key)."""
    return F.md5(_key(cols, seed))


def hash32(cols: Sequence[str | Column], seed: int | str) -> Column:
    """Unsigned 32-bit value from the first 8 hex digits of the seeded md5."""
    return F.conv(F.substring(hash_hex(cols, seed), 1, 8), 16, 10).cast("bigint")


def hash_bucket(cols: Sequence[str | Column], seed: int | str, n: int | Column) -> Column:
    """Bucket in [0, n)."""
    return F.pmod(hash32(cols, seed), n if isinstance(n, Column) else F.lit(n))


def sql_hash32(cols: Sequence[str], seed: int | str) -> str:
    """The DuckDB text of :func:`hash32` (for oracles)."""
    key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols) + f" || '|{seed}'"
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


def sql_hash_hex(cols: Sequence[str], seed: int | str) -> str:
    key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols) + f" || '|{seed}'"
    return f"md5({key})"
