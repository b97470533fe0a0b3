"""DuckDB text of the scalar functions, for oracle queries. Patterns are the
same strings the Spark functions use (read identically by Java and RE2)."""

from __future__ import annotations

from ..functions.text import NON_ASCII, PY_SPACE, TAG
from ..functions.tokens import CLS_ID, FIRST_WORD_ID, SEP_ID, VOCAB_SIZE

# Entities decoded by the oracle's stand-in for html.unescape
# ('&amp;' last, so '&amp;lt;' stays '&lt;' as in a single left-to-right pass).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{PY_SPACE}+|{PY_SPACE}+\\z', '', 'g')"  # regex form: independent of btrim


def unescape(e: str) -> str:
    for a, b in ENTITIES:
        e = f"replace({e}, {lit(a)}, {lit(b)})"
    return e


def clean_rec(e: str, unesc: bool = True) -> str:
    e = strip(unescape(e) if unesc else e)
    e = f"regexp_replace({e}, '{TAG}', '', 'g')"
    e = f"regexp_replace({e}, '[\\n\\t]', ' ', 'g')"
    e = f"regexp_replace({e}, ' +', ' ', 'g')"
    return f"regexp_replace({e}, '{NON_ASCII}', ' ', 'g')"


def final_dot(e: str) -> str:
    return f"(CASE WHEN regexp_matches({e}, '^\\.+\\z') THEN '..' ELSE regexp_replace({e}, '\\.+\\z', '') || '.' END)"


def clean_search(e: str, unesc: bool = True) -> str:
    e = unescape(e) if unesc else e
    return final_dot(f"regexp_replace({e}, '[\"\\n\\r]', '', 'g')")


def flat(e: str) -> str:
    return strip(f"replace(replace(replace({e}, chr(9), ' '), chr(10), ' '), chr(13), '')")


def tokens(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def hash32(e: str) -> str:
    return f"CAST(('0x' || substr(md5({e}), 1, 8)) AS BIGINT)"


def text_to_ids(e: str) -> str:
    word = f"{hash32('t || ' + lit('|vocab'))} % {VOCAB_SIZE - FIRST_WORD_ID} + {FIRST_WORD_ID}"
    return (f"list_concat([CAST({CLS_ID} AS BIGINT)], list_transform({tokens(e)}, lambda t: {word}), "
            f"[CAST({SEP_ID} AS BIGINT)])")


def ids_text(e: str) -> str:
    return f"array_to_string({e}, ' ')"


def stop_words_list() -> str:
    from ..functions.stopwords import ENGLISH

    return "[" + ", ".join(lit(w) for w in sorted(set(ENGLISH))) + "]"


def tokens_sw(e: str) -> str:
    return (f"list_filter(regexp_split_to_array({e}, '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda t: t <> '' AND NOT list_contains({stop_words_list()}, t))")


def hash_long(src: str, key: str, text: str, dim: int = 64) -> str:
    """Body of a CTE (key, d, v): mean-pooled feature-hashing vector, non-zero slots."""
    return f"""
        SELECT {key}, d, sum(s) / max(ntok) AS v FROM (
            SELECT {key}, ntok, {hash32("t || '|dim'")} % {dim} AS d, 1 - 2 * ({hash32("t || '|sign'")} % 2) AS s
            FROM (SELECT {key}, unnest(toks) AS t, len(toks) AS ntok FROM (SELECT {key}, {tokens(text)} AS toks FROM {src})))
        GROUP BY {key}, d HAVING sum(s) <> 0"""


def dense_from_long(ids: str, key: str, long: str, dim: int = 64) -> str:
    """Body of a CTE (key, vec): dense list with zeros from the long form."""
    return f"""
        SELECT i.{key}, list(coalesce(l.v, 0.0) ORDER BY g.d) AS vec
        FROM (SELECT DISTINCT {key} FROM {ids}) i CROSS JOIN range({dim}) g(d)
        LEFT JOIN {long} l ON l.{key} = i.{key} AND l.d = g.d
        GROUP BY i.{key}"""


def cosine(a: str, b: str) -> str:
    na, nb = f"sqrt(list_dot_product({a}, {a}))", f"sqrt(list_dot_product({b}, {b}))"
    return f"(CASE WHEN {na} > 0 AND {nb} > 0 THEN list_dot_product({a}, {b}) / ({na} * {nb}) ELSE 0.0 END)"
