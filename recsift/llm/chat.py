"""Chat formatting with a grammar round trip (DataFrame functions only).

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<s>" ( "[INST]" head text "[/INST]" | head text "</s>" )
    head         := role "\\n"

The second form is the one under the loss mask (trainable roles). Every
conversation is first rendered with its texts unchanged and reparsed by the
grammar; where the recovered turns differ from the source, the turns whose own
rendering does not reparse to themselves are escaped, and the result is
reparsed again. A conversation that still differs fails the job. An escaped
control string carries one more backslash after its first character
(``</s>`` -> ``<\\/s>``), so unescaping is exact.

Defined cases: null text and null role are empty; rows of a conversation are
ordered by (turn, role, text), so ties and repeated rows are kept and their
order is fixed; a null ``conv_id`` is one conversation of its own; an empty
table gives an empty result; columns other than the four named are ignored.
A conversation is one output record and must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, USER_OPEN, USER_CLOSE, LOSS_CLOSE = "<s>", "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1")
    return F.regexp_replace(out, r"\[(\\*/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    out = F.regexp_replace(text, r"<\\(\\*/?s>)", "<$1")
    return F.regexp_replace(out, r"\[\\(\\*/?INST\])", "[$1")


def _has_control(text: Column) -> Column:
    return text.rlike(r"</?s>|\[/?INST\]")


def _escape_role(role: Column) -> Column:
    # after this a role has no line break, and every backslash is followed by b or n
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render_turn(role: Column, text: Column, train: Column) -> Column:
    head = F.concat(_escape_role(role), F.lit("\n"), text)
    return F.when(train, F.concat(F.lit(TURN), head, F.lit(LOSS_CLOSE))) \
        .otherwise(F.concat(F.lit(TURN + USER_OPEN), head, F.lit(USER_CLOSE)))


def parse(formatted: Column) -> Column:
    """Deterministic parser: array of (role, text, train); a segment outside the
    grammar (control string inside, wrong close) gives a null entry."""
    segments = F.slice(F.split(formatted, TURN, -1), F.lit(2), F.greatest(F.size(F.split(formatted, TURN, -1)) - 1, F.lit(0)))

    def turn(seg: Column) -> Column:
        user = seg.startswith(USER_OPEN)
        n_open = F.when(user, F.lit(len(USER_OPEN))).otherwise(F.lit(0))
        n_close = F.when(user, F.lit(len(USER_CLOSE))).otherwise(F.lit(len(LOSS_CLOSE)))
        closed = F.when(user, seg.endswith(USER_CLOSE)).otherwise(seg.endswith(LOSS_CLOSE))
        body = F.substring(seg, n_open + 1, F.greatest(F.length(seg) - n_open - n_close, F.lit(0)))
        cut = F.instr(body, "\n")
        role = F.substring(body, F.lit(1), cut - 1)
        text = F.substring(body, cut + 1, F.length(body))
        ok = closed & (cut > 0) & ~_has_control(body)
        return F.when(ok, F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"),
                                   (~user).alias("train")))
    return F.transform(segments, turn)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, turns`` where
    ``loss_spans`` are the (start, end) code-point spans of ``formatted`` under the
    loss mask and ``turns`` is what the parser reads back. See the module text."""
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role), F.lit("")).alias("role"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("train", F.col("role").isin(*train_roles))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", "role", "text", "train"))).alias("src"))
    bare = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["train"].alias("train"))
    joined = lambda turns: F.array_join(turns, "")
    raw = F.transform("src", lambda t: render_turn(t["role"], t["text"], t["train"]))
    # round 1: unchanged texts
    g = grouped.withColumn("source", F.transform("src", bare)).withColumn("plain", joined(raw))
    g = g.withColumn("same", F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))

    # round 2: escape each turn whose own rendering does not reparse to itself
    def fixed(t: Column) -> Column:
        alone = render_turn(t["role"], t["text"], t["train"])
        ok = F.coalesce(parse(alone) == F.array(bare(t)), F.lit(False))
        return F.when(ok, alone).otherwise(render_turn(t["role"], escape(t["text"]), t["train"]))
    g = g.withColumn("parts", F.when(F.col("same"), raw).otherwise(F.transform("src", fixed)))
    g = g.withColumn("formatted", joined(F.col("parts"))).withColumn("turns", parse(F.col("formatted")))
    g = g.withColumn("turns", F.when(F.coalesce(F.col("turns") == F.col("source"), F.lit(False)), F.col("turns"))
                     .otherwise(F.raise_error(F.lit("formatted conversation does not reparse to its source"))
                                .cast("array<struct<role:string,text:string,train:boolean>>")))
    return g.select("conv_id", "formatted", "turns", "parts")


def loss_spans(formatted: DataFrame) -> DataFrame:
    """The mask as rows: ``conv_id, turn_no, start, end`` (code points of
    ``formatted``, end exclusive) of every trainable text, escaped as it stands there."""
    x = formatted.select("conv_id", F.posexplode(F.arrays_zip("parts", "turns")).alias("turn_no", "p"))
    x = x.select("conv_id", "turn_no", F.length("p.parts").cast("long").alias("n"), "p.turns.train",
                 (F.length(_escape_role(F.col("p.turns.role"))) + len(TURN) + 1).alias("head"))
    w = Window.partitionBy("conv_id").orderBy("turn_no")
    x = x.withColumn("stop", F.sum("n").over(w))
    return x.filter("train").select("conv_id", "turn_no", (F.col("stop") - F.col("n") + F.col("head")).alias("start"),
                                    (F.col("stop") - len(LOSS_CLOSE)).alias("end"))


def digest(formatted: DataFrame) -> DataFrame:
    """Contract columns, all taken from what the parser read back."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["train"]), lambda t: t["text"]), "")
    return (formatted.withColumn("loss", loss)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
