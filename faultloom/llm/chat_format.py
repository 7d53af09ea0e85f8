"""Chat formatting of event-sourced conversations, in DataFrame functions only.

A conversation is a log of events. The tables hold final turns only, so the query makes a log of them with `logged_events`
and takes its turns from the fold. `fold_events` rebuilds the turns from it: events are put in order by
sequence number within (conversation, turn), an edit or a regeneration starts the turn's text anew, and deltas
add to it. `render` writes the turns with a template and gives the spans under the loss mask, and
`read_back` parses a rendered text to turns again.

Template: "### role: text</turn>\\n" for each turn. In roles and texts the strings that mark turns are escaped
reversibly: backslash to \\b, "###" to \\h, "</turn>" to \\t, and in roles also ":" to \\c. After it no
"###" or "</turn>" is left in them, so a turn ends at the first "</turn>".

How it is dealt out: the turns of a conversation meet in one row, as its text must; events meet by (conversation,
turn), with a running sum in place of a fold over a list. There is no Python in the plan.

Edge cases: a null text is empty and so is a null role; turns with the same number are ordered by role, then
text, nulls first; repeated rows are repeated turns; a null turn number comes first; rows without a conversation form one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

_END = "</turn>"
_CODES = [("\\", "\\b"), ("###", "\\h"), (_END, "\\t"), (":", "\\c")]


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in _CODES[: 4 if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def logged_events(turns: DataFrame) -> DataFrame:
    """A log (conv_id, row, seq, turn, role, kind, text) whose fold by (conv_id, turn, row) gives the turns (conv_id, turn, role, text).

    A text comes in three deltas. Of three turns, by a hash, one has a draft that a regeneration drops and one a draft that an edit
    replaces. `row` keeps turns of the same number apart. A turn's events are logged last first, so that only seq orders them.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")
    how = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(3))
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), (F.col("role") if seq == 0 else F.lit(None).cast("string")).alias("role"), F.lit(kind).alias("kind"), text.alias("text"))
    first, second, rest = F.substr(text, F.lit(1), third), F.substr(text, third + 1, third), F.substr(text, 2 * third + 1)
    draft, tail = event(0, "delta", F.concat(rest, F.lit("..."))), [event(4, "delta", rest), event(3, "delta", second)]
    log = F.when(how == 0, F.array(*tail, event(0, "delta", first)))
    log = log.when(how == 1, F.array(*tail, event(2, "delta", first), event(1, "regenerate", F.lit(None).cast("string")), draft))
    log = log.otherwise(F.array(*tail, event(2, "edit", first), draft))
    keyed = turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    return keyed.select("conv_id", "row", "turn", F.explode(log).alias("e")).select("conv_id", "row", "e.seq", "turn", "e.role", "e.kind", "e.text")


def fold_events(events: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """Final turns (conv_id, turn, role, text) of a log (conv_id, seq, turn, role, kind, text).

    kind: "edit" replaces the turn's text, "regenerate" starts it anew, "delta" adds to it and "delete" removes the turn; any
    other kind counts as a delta. The role is the last one that is not null. apart: columns of the log that tell turns of the same
    number in a conversation apart.
    """
    key = ("conv_id", "turn", *apart)
    own = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.sum(F.when(F.col("kind").isin("edit", "regenerate", "delete"), 1).otherwise(0)).over(own)
    held = events.withColumn("version", starts)
    last = held.groupBy(*key, "version").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))), lambda e: e["text"]), "").alias("text"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.max(F.coalesce(F.col("kind") == "delete", F.lit(False))).alias("gone"),
        F.max("seq").alias("seq"),
    )
    by = F.when(F.col("role").isNotNull(), F.col("version"))
    final = last.groupBy(*key).agg(F.max_by(F.struct("text", "gone"), "version").alias("v"), F.max_by("role", by).alias("role"))
    return final.where("NOT v.gone").select("conv_id", "turn", "role", F.col("v.text").alias("text"))


def render(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of turns (conv_id, turn, role, text).

    loss_spans holds (begin, length) in code points of the texts of the role `learned`, in order.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("### "), escaped(role, True), F.lit(": "))
    body = escaped(text)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"), (role == learned).alias("learned"))
    parts = parts.withColumn("whole", F.concat("head", "body", F.lit(f"{_END}\n")))
    parts = parts.withColumn("begin", F.coalesce(F.sum(F.length("whole")).over(order), F.lit(0)) + F.length("head"))
    parts = parts.withColumn("place", F.coalesce(F.count("*").over(order), F.lit(0)))
    kept = F.array_sort(F.collect_list(F.struct("place", "whole", "begin", F.length("body").alias("length"), "learned")))
    return parts.groupBy("conv_id").agg(kept.alias("t")).select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["whole"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learned"]), lambda x: F.struct(x["begin"].alias("begin"), x["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text), loss_text, formatted_chars) read from rendered texts and their spans alone."""
    pieces = F.split("formatted", f"{_END}\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        colon = F.position(F.lit(": "), piece)
        return F.struct(unescaped(F.substr(piece, F.lit(5), colon - 5)).alias("role"), unescaped(F.substr(piece, colon + 2)).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["begin"] + 1).cast("int"), s["length"])))
    return rendered.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)"
    logged = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(own))
    back = read_back(render(fold_events(logged_events(logged), ("row",))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


SQL = {
    "op10_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(len(body) + len(head) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
