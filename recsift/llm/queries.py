"""The training-data queries and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fim, fingerprints, hardneg, jaccard, langid, licences, linededup, packing, simhash, toxicity, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _words(col: str) -> str:
    """DuckDB: the A-Z-lowered alphanumeric words of a text."""
    return (f"regexp_extract_all(translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            f"'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS top, count(*) AS c FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN c > 1 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN c > 1 AND top <> page_id THEN top END AS refers_to
FROM d LEFT JOIN m ON d.digest = m.digest
"""


@_query("op1_warc", WARC_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'),
                               '\[(\\*/?INST\])', '[\\\1', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(role) + length(CASE WHEN escaped <> text AND regexp_matches(text, '<\\*/?s>|\[\\*/?INST\]') THEN escaped ELSE text END)
      + CASE WHEN role = 'assistant' THEN 8 ELSE 17 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@_query("op2_chat_format", CHAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.format_conversations(conv.unionByName(extra)))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS g FROM (
  SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""".replace("\\\\", "\\")


@_query("op3_jaccard_join", JACCARD_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(jaccard.JaccardJoin().components(table(spark, sf_dir, "documents")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), added=True)


@_query("op5_licence_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


@_query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@_query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, counts=True)


@_query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.fingerprint_edits(table(spark, sf_dir, "documents")))


@_query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (langid.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


DECONTAM_SQL = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
i AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
    array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN iw ON dw.gram = iw.gram AND dw.k = iw.k),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
  SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@_query("op10_decontaminate", DECONTAM_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


FIM_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') END AS tok FROM t),
v AS (SELECT *, len(tok) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(tok) + 1) AS x,
  CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(tok) + 1) AS y, CASE
    WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, array_to_string(list_slice(tok, 1, least(x, y)), '') AS p,
  array_to_string(list_slice(tok, least(x, y) + 1, greatest(x, y)), '') AS m,
  array_to_string(list_slice(tok, greatest(x, y) + 1, n), '') AS s FROM v)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM w
"""


@_query("op11_fill_in_middle", FIM_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.restore(fim.transform(table(spark, sf_dir, "documents"))))


HARD_SQL = """
WITH x AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
d AS (SELECT len(e) AS d FROM x GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
v AS (SELECT vec_id, min_by(label, (label, e)) AS label, list_transform(min_by(e, (label, e)), lambda y: floor(256 * y)) AS i
  FROM x, d WHERE len(e) = d.d GROUP BY vec_id),
s AS (SELECT a.vec_id AS a, o.vec_id AS o, a.label = o.label AS same,
    CAST(list_dot_product(a.i, o.i) AS BIGINT) AS s FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, o AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, o) <= 5),
n AS (SELECT p.a, p.p, p.ps, s.o, s.s, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.o) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.ps <= 100 * s.s AND 100 * s.s <= 100 * p.ps)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, o AS negative_id, ps AS positive_score, s AS negative_score
FROM n WHERE r <= 5
"""


@_query("op12_hard_negatives", HARD_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0)


@_query("op13_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))
