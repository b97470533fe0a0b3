"""Line dedup by a log-template tree (DataFrame functions only).

Every line is parsed at fixed depth: tokens (separated by spaces) with digits become
``<*>``; the leaf is the number of tokens and the first ``DEPTH`` tokens; the later tokens
are kept as hashes. Inside a leaf the template keeps, for each token, what most of the leaf's
(document, line) pairs have there; tokens on which lines differ are variable fields. A line
belongs to the template when at least ``SIMILARITY`` of its tokens agree with it, however long
it is. Lines left over form the leaf's next template, for at most ``ROUNDS`` templates. What is
left then is compared line by line: a line that agrees in ``SIMILARITY`` of its tokens with
another one of the leaf shares that line's template, any other line is a template of its own.
Two such lines have one of their rarest tokens (as many as may differ, plus one) in common, so
only lines that share one are compared.

A template that occurs in several documents recurs: its lines are dropped from all documents
but the first (smallest doc_id), so no text is lost from the corpus. Short lines need more
documents, since they may agree by chance, and very short ones are never dropped.

Leaves and templates are only ever counted, never collected: the tokens of a leaf are looked
at once per different line, and only for leaves with several.

Defined cases: a null text stays null, an empty one empty; empty lines are kept; rows with
equal (doc_id, text) are one document and get the same result; a null doc_id comes first; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release
from .components import connected_components

DEPTH = 3
SIMILARITY = 0.8
ROUNDS = 3                         # majority templates of a leaf, before lines are compared in pairs
MIN_TOKENS = 3                     # shorter lines are kept
SHORT_TOKENS, SHORT_DOCS = 10, 5   # lines below SHORT_TOKENS need SHORT_DOCS documents
MIN_DOCS = 2
BROADCAST_LEAVES = 2_000_000       # leaves of several forms that are broadcast (8 bytes each)


def masked(line: Column) -> Column:
    """The line with every token that holds a digit replaced by ``<*>``."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "<*>")).otherwise(line)


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(masked(line), " "), "")


def _leaf(tok: Column) -> Column:
    return F.xxhash64(F.size(tok), F.slice(tok, 1, DEPTH))


def parse_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, pos, n_tokens, leaf, form, later`` (hashes of the later tokens) of all lines of ``MIN_TOKENS`` or more."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                    F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    x = x.select("doc_id", "text_hash", "pos", tokens(F.col("line")).alias("tok")).filter(F.size("tok") >= MIN_TOKENS)
    later = F.slice("tok", F.lit(DEPTH + 1), F.greatest(F.size("tok") - DEPTH, F.lit(0)))
    return x.select("doc_id", "text_hash", "pos", F.size("tok").alias("n_tokens"), _leaf(F.col("tok")).alias("leaf"),
                    F.xxhash64("tok").alias("form"), F.transform(later, lambda t: F.hash(t)).alias("later"))


def _enough(docs: Column) -> Column:
    return docs >= F.when(F.col("n_tokens") < SHORT_TOKENS, SHORT_DOCS).otherwise(MIN_DOCS)


def _agree(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _needed() -> Column:
    """Later tokens that must agree."""
    return F.ceil(F.col("n_tokens") * SIMILARITY - 1e-9) - DEPTH


def _majority(left: DataFrame) -> DataFrame:
    """``t_leaf, shape``: for each later token what most (document, line) pairs of the leaf have."""
    words = left.select("leaf", "docs", F.posexplode("later").alias("at", "what"))
    most = words.groupBy("leaf", "at", "what").agg(F.sum("docs").alias("n")) \
        .groupBy("leaf", "at").agg(F.max(F.struct("n", "what")).alias("top"))
    return most.groupBy(F.col("leaf").alias("t_leaf")).agg(F.array_sort(F.collect_list(F.struct("at", "top.what"))).alias("s")) \
        .select("t_leaf", F.col("s.what").alias("shape"))


def _alike_pairs(forms: DataFrame, left: DataFrame) -> DataFrame:
    """``a, b``: the pairs of a form of ``left`` and any other form of its leaf that agree in
    enough tokens."""
    open_leaf = left.select(F.col("leaf").alias("o_leaf")).distinct()
    near = forms.join(open_leaf, F.col("leaf") == F.col("o_leaf"), "left_semi") \
        .join(left.select(F.col("form").alias("l_form"), F.lit(True).alias("left")), F.col("form") == F.col("l_form"), "left")
    near = materialise(near.select("leaf", "form", "n_tokens", "later", F.coalesce("left", F.lit(False)).alias("left")), "line-open")
    words = near.select("leaf", "form", "n_tokens", "left", F.posexplode("later").alias("at", "what"))
    df = words.groupBy(F.col("leaf").alias("c_leaf"), F.col("at").alias("c_at"), F.col("what").alias("c_what")).agg(
        F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = words.join(df, (F.col("leaf") == F.col("c_leaf")) & (F.col("at") == F.col("c_at")) & (F.col("what") == F.col("c_what")))
    own = Window.partitionBy("form")
    shared = shared.withColumn("shared", F.count(F.lit(1)).over(own)) \
        .withColumn("nth", F.row_number().over(own.orderBy("df", "at")))
    prefix = materialise(shared.filter(F.col("nth") <= F.col("shared") - _needed() + 1)
                         .select("leaf", "at", "what", "form", "left"), "line-prefixes")
    release(forms.sparkSession)
    one, two = prefix.filter("left").alias("p"), prefix.alias("q")
    pairs = one.join(two, (F.col("p.leaf") == F.col("q.leaf")) & (F.col("p.at") == F.col("q.at")) & (F.col("p.what") == F.col("q.what"))
                     & ((F.col("p.form") < F.col("q.form")) | (~F.col("q.left") & (F.col("p.form") != F.col("q.form")))))
    pairs = pairs.select(F.col("p.form").alias("a"), F.col("q.form").alias("b")).distinct()
    x = pairs.join(near.select(F.col("form").alias("a"), "n_tokens", F.col("later").alias("la")), "a") \
        .join(near.select(F.col("form").alias("b"), F.col("later").alias("lb")), "b")
    return materialise(x.filter(_agree("la", "lb") >= _needed()).select("a", "b"), "line-pairs")


def recurring(lines: DataFrame) -> DataFrame:
    """``leaf, form, first``: the line forms of recurring templates, with the document that
    keeps its lines."""
    doc = F.struct("doc_id", "text_hash")
    pairs = lines.select("leaf", "form", "n_tokens", "doc_id", "text_hash").distinct()
    forms = materialise(pairs.groupBy("leaf", "form", "n_tokens").agg(
        F.count(F.lit(1)).alias("docs"), F.min(doc).alias("own")), "line-forms")
    release(lines.sparkSession)
    exact = forms.filter(_enough(F.col("docs"))).select("leaf", "form", "own")

    # leaves with several forms: generalise
    wide = materialise(forms.groupBy(F.col("leaf").alias("w_leaf")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w_leaf"),
                       "line-leaves")
    in_wide = F.col("leaf") == F.col("w_leaf")
    cand = forms.join(wide, in_wide, "left_semi").filter(F.col("n_tokens") > DEPTH) \
        .select(F.col("leaf").alias("c_leaf"), F.col("form").alias("c_form"), "docs")
    # tokens of lines alone in their leaf do not move while the counted leaves can be shipped
    words = lines.filter(F.col("n_tokens") > DEPTH)
    if wide.count() <= BROADCAST_LEAVES:
        words = words.join(F.broadcast(wide), in_wide, "left_semi")
    # copies of a line are combined before they move: a form has one row on either side of the join, which finds them in place
    words = words.groupBy("leaf", "form").agg(F.first("n_tokens").alias("n_tokens"), F.first("later").alias("later"))
    mine = words.join(cand, (F.col("leaf") == F.col("c_leaf")) & (F.col("form") == F.col("c_form")))
    left = wide_lines = materialise(mine.select("leaf", "form", "n_tokens", "docs", "later"), "line-tokens")
    release(lines.sparkSession)
    inside, open_leaves = None, wide_lines
    for turn in range(ROUNDS):
        x = open_leaves.join(_majority(open_leaves), F.col("leaf") == F.col("t_leaf"))
        member = materialise(x.filter(_agree("later", "shape") >= _needed()).select(
            "leaf", "form", F.xxhash64("leaf", F.lit(turn)).alias("node")), "line-members")
        if member.isEmpty():
            break
        inside = member if inside is None else inside.unionByName(member)
        gone = member.select(F.col("form").alias("m_form"))
        left = left.join(gone, F.col("form") == F.col("m_form"), "left_anti")
        again = member.select(F.col("leaf").alias("m_leaf")).distinct()
        open_leaves = left.join(again, F.col("leaf") == F.col("m_leaf"), "left_semi")
    none = wide_lines.select("leaf", "form", F.lit(0).cast("long").alias("node")).limit(0)
    inside = none if inside is None else inside
    links = _alike_pairs(wide_lines, left)
    # a template stands for its members
    of = inside.select(F.col("form").alias("m_form"), "node")
    ends = links.join(of, F.col("b") == F.col("m_form"), "left").select("a", F.coalesce("node", "b").alias("b"))
    comps = connected_components(ends, "line-components")
    single = left.select("leaf", "form", F.col("form").alias("own_node")).join(
        comps.select("node"), F.col("form") == F.col("node"), "left_semi")
    all_in = inside.select("leaf", "form", F.col("node").alias("own_node")).unionByName(single)
    all_in = all_in.join(comps, F.col("own_node") == F.col("node"), "left").select(
        F.col("leaf").alias("m_leaf"), F.col("form").alias("m_form"), F.coalesce("comp", "own_node").alias("template"))
    all_in = materialise(all_in, "line-templates")
    release(lines.sparkSession)
    # distinct documents of the generalised template
    of = pairs.join(all_in, (F.col("leaf") == F.col("m_leaf")) & (F.col("form") == F.col("m_form")))
    general = of.select("template", "n_tokens", "doc_id", "text_hash").distinct().groupBy("template", "n_tokens").agg(
        F.count(F.lit(1)).alias("docs"), F.min(doc).alias("top")).filter(_enough(F.col("docs"))) \
        .select(F.col("template").alias("g_template"), "top")
    wide_forms = all_in.join(general, F.col("template") == F.col("g_template")).select(
        F.col("m_leaf").alias("leaf"), F.col("m_form").alias("form"), F.col("top").alias("whole"))
    both = exact.withColumn("whole", F.lit(None).cast(wide_forms.schema["whole"].dataType)).unionByName(
        wide_forms.withColumn("own", F.lit(None).cast(exact.schema["own"].dataType)))
    return both.groupBy("leaf", "form").agg(F.max("whole").alias("whole"), F.max("own").alias("own")).select(
        "leaf", "form", F.coalesce("whole", "own").alias("first"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d_id, d_hash, drop``: line numbers to drop of each document that has some."""
    lines = materialise(parse_lines(docs, id_col, text_col), "lines")
    rec = materialise(recurring(lines).select(
        F.col("leaf").alias("r_leaf"), F.col("form").alias("r_form"), "first"), "recurring")
    release(docs.sparkSession)
    x = lines.join(rec, (F.col("leaf") == F.col("r_leaf")) & (F.col("form") == F.col("r_form")))
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash"))
    return x.filter(~mine).groupBy(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash")).agg(
        F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counts: bool = False) -> DataFrame:
    """``docs`` with recurring lines dropped from the text; with ``counts`` also
    ``n_lines`` and ``n_dropped``."""
    gone = dropped_lines(docs, id_col, text_col).toDF("__d_id", "__d_hash", "__drop")
    x = docs.join(gone, docs[id_col].eqNullSafe(gone["__d_id"]) & (F.xxhash64(docs[text_col]) == gone["__d_hash"]), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda p, i: ~F.array_contains(F.col("__drop"), i)), "\n")
    n_lines, n_dropped = F.size(parts), F.coalesce(F.size("__drop"), F.lit(0))
    cols = [F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(kept).alias(c) if c == text_col else docs[c]
            for c in docs.columns]
    if counts:
        cols += [F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
                 F.when(F.col("__drop").isNull(), 0).otherwise(n_dropped).cast("long").alias("n_dropped")]
    return x.select(*cols)
