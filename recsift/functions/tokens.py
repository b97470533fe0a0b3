"""Token-id columns (F19) for training rows: a feature-hashing vocabulary,
truncation/padding and attention masks. The sub-word tokenizer of the
reference is a per-row library and stays outside; token arrays are inputs
to the masking operator, and this hashing vocabulary makes them from text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokenize

# Special token ids of the hashing vocabulary.
PAD_ID, CLS_ID, SEP_ID, MASK_ID = 0, 101, 102, 103
FIRST_WORD_ID = 1000
VOCAB_SIZE = 30000


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def hash_token_id(tok: Column, vocab_size: int = VOCAB_SIZE) -> Column:
    """Word → id in [FIRST_WORD_ID, vocab_size) via md5 (same in DuckDB)."""
    h = F.conv(F.substring(F.md5(F.concat(tok, F.lit("|vocab"))), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(vocab_size - FIRST_WORD_ID)) + F.lit(FIRST_WORD_ID)


def text_to_ids(col: str | Column, vocab_size: int = VOCAB_SIZE) -> Column:
    """[CLS] word ids [SEP] for the whole text."""
    ids = F.transform(tokenize(_c(col)), lambda t: hash_token_id(t, vocab_size))
    return F.concat(F.array(F.lit(CLS_ID).cast("bigint")), ids, F.array(F.lit(SEP_ID).cast("bigint")))


def truncate_pad(ids: str | Column, max_len: int, pad: int = PAD_ID) -> Column:
    """first ``max_len`` ids, padded with ``pad`` to exactly ``max_len``."""
    c = F.slice(_c(ids), 1, max_len)
    return F.concat(c, F.array_repeat(F.lit(pad).cast("bigint"), F.lit(max_len) - F.size(c)))


def attention_mask(ids: str | Column, max_len: int) -> Column:
    """1 for real tokens, 0 for padding, length ``max_len``."""
    n = F.least(F.size(_c(ids)), F.lit(max_len))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))


def ids_text(col: str | Column) -> Column:
    """Space-joined id list (stable text form for sinks and hashing)."""
    return F.concat_ws(" ", F.transform(_c(col), lambda x: x.cast("string")))
