"""Scalar text functions as Column expressions.

All run JVM-side inside whole-stage codegen except :func:`html_unescape`,
which needs the full HTML5 entity table and is an Arrow-batched pandas UDF
that only receives the rows containing ``&`` (others cross as null).
The regular expressions are written so Java and RE2 (the DuckDB oracle) read
them the same way.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes (str.isspace).
PY_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PY_SPACE_CHARS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                   0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TAG = r"<[^>]+>"
NON_ASCII = r"[^\x{0}-\x{7f}]"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: str | Column) -> Column:
    """Python ``str.strip()``: Unicode white space at both ends (plain trim
    only removes spaces); ``btrim`` with the character set is native."""
    return F.btrim(_c(col), F.lit(PY_SPACE_CHARS))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    import html

    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


def html_unescape(col: str | Column) -> Column:
    """Python ``html.unescape`` (F4). Only rows with '&' are shipped to Python."""
    c = _c(col)
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def strip_tags(col: str | Column) -> Column:
    """remove ``<...>`` tags."""
    return F.regexp_replace(_c(col), TAG, "")


def clean_rec_text(col: str | Column, unescape: bool = True) -> Column:
    """D7 per-value cleaner, in the reference's order: unescape → strip → tags
    → newline/tab to space → collapse spaces → each non-ASCII code point to a
    space (spaces made by the last step stay)."""
    c = html_unescape(col) if unescape else _c(col)
    c = py_strip(c)
    c = F.regexp_replace(c, TAG, "")
    c = F.regexp_replace(c, r"[\n\t]", " ")
    c = F.regexp_replace(c, " +", " ")
    return F.regexp_replace(c, NON_ASCII, " ")


def final_dot(col: str | Column) -> Column:
    """end with exactly one dot; all-dot text becomes '..', '' becomes '.'."""
    c = _c(col)
    return F.when(c.rlike(r"^\.+\z"), F.lit("..")).otherwise(F.concat(F.regexp_replace(c, r"\.+\z", ""), F.lit(".")))


def clean_search_text(col: str | Column, unescape: bool = True) -> Column:
    """D8 per-field cleaner: unescape, drop quotes and line breaks, final dot."""
    c = html_unescape(col) if unescape else _c(col)
    return final_dot(F.regexp_replace(c, "[\"\n\r]", ""))


def flatten_field(col: str | Column, sep: str) -> Column:
    """F8 / F18 for a string-or-list field: arrays are joined with ``sep``."""
    return F.array_join(_c(col), sep)


def number_text(col: str | Column) -> Column:
    """a number field becomes its text plus '.' (Java prints large
    doubles in exponent form where Python does not)."""
    return F.concat(_c(col).cast("string"), F.lit("."))


def flat_text(col: str | Column) -> Column:
    """tab and newline → space, carriage return removed, then strip. ``replace`` and ``btrim`` walk the whole
    text byte by byte and are slow on long ones, so the rare characters are replaced where a text contains any, and a
    text is stripped where it starts or ends with white space. The lambdas name a step's result, which is computed once."""
    def rare(c):
        flat = F.replace(F.replace(c, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(""))
        return F.when(c.contains("\t") | c.contains("\r"), flat).otherwise(c)

    def strip(c):
        edges = [e for x in PY_SPACE_CHARS for e in (c.startswith(x), c.endswith(x))]
        return F.when(reduce(or_, edges), py_strip(c)).otherwise(c)

    c = F.replace(_c(col), F.lit("\n"), F.lit(" "))
    return F.transform(F.transform(F.array(c), rare), strip)[0]


def tokenize(col: str | Column, stop_words: list[str] | None = None, pattern: str = r"[^\p{L}\p{N}]+") -> Column:
    """case-sensitive word tokens (split on non-letter/digit runs, empty
    tokens dropped), minus ``stop_words``."""
    toks = F.filter(F.split(_c(col), pattern), lambda t: t != F.lit(""))
    if stop_words:
        # IN over many literals is optimised to a hash-set lookup (InSet)
        sw = sorted(set(stop_words))
        toks = F.filter(toks, lambda t: ~t.isin(*sw))
    return toks


def category_file_name(col: str | Column) -> Column:
    """F16: category → file stem (space → underscore)."""
    return F.replace(_c(col), F.lit(" "), F.lit("_"))
