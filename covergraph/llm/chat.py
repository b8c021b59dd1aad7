"""Chat formatting by event sourcing, in DataFrame operations only.

A log of events is partitioned by conversation and sorted by sequence. Events of one message are
folded: ``message`` (or ``edit``, ``regenerate``) starts its text anew, ``delta`` appends to it,
``delete`` removes the message. The final messages are rendered in turn order.

Rendering. A turn is ``<s>[TAG]text[/TAG]</s>``; the tag is INST for user, RESP for assistant,
ROLE=name for another role and ROLE for a null or empty one. Control strings inside texts are
escaped reversibly: a backslash becomes ``\\e``, the first character of a control string becomes
``\\l`` (for <) or ``\\b`` (for [), and in role names ] becomes ``\\r``; so no control string is
left in an escaped text. The loss covers the texts between [RESP] and [/RESP].

One exchange, on the conversation, carries the texts; the fold and the rendering reuse it. A
conversation is one string in the end, so its rows have to meet once.

Nulls: null text is empty, a null kind is a message, a null role is rendered as the empty one; null
conversation ids form one conversation; null turns come first. Rows that tie on (turn, part,
sequence) are ordered by kind, role and text; repeated rows are separate events. An empty log gives
no rows. Columns that are not named in the call are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[RESP]", "[/RESP]", "[ROLE", "[/ROLE"]
RESET = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\e"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(("\\l" if c[0] == "<" else "\\b") + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\b", "["), ("\\r", "]"), ("\\e", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def tag(role: Column) -> Column:
    named = F.concat(F.lit("ROLE="), F.replace(escape(role), F.lit("]"), F.lit("\\r")))
    return F.when(role == "user", "INST").when(role == "assistant", "RESP").when(F.coalesce(role, F.lit("")) == "", "ROLE").otherwise(named)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of events (conv_id, turn, part, seq, kind, role, text).

    A message is a (conv_id, turn, part). What counts is the last reset of a message and the deltas
    after it; its role is that reset's. A message without a reset starts empty, with its first role.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    message = Window.partitionBy("conv_id", "turn", "part")
    order = message.orderBy("seq", "kind", F.col("role"), F.col("text"))
    numbered = (
        events.select("conv_id", "turn", "part", "seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
        .repartition(F.col("conv_id"))
        .withColumn("i", F.row_number().over(order))
    )
    live = numbered.withColumn("from", F.coalesce(F.max(F.when(F.col("kind").isin(*RESET, "delete"), F.col("i"))).over(message), F.lit(0)))
    return (
        live.where(F.col("i") >= F.col("from"))
        .groupBy("conv_id", "turn", "part")
        .agg(F.array_sort(F.collect_list(F.struct("i", "kind", "role", "text"))).alias("e"))
        .where(F.col("e")[0]["kind"] != "delete")
        .select("conv_id", "turn", "part", F.col("e")[0]["role"].alias("role"), F.array_join(F.col("e")["text"], "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, formatted, loss_spans (start and length in code points)."""
    name = tag(F.col("role"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "part", "role", "text")
    turns = messages.select(
        "conv_id", "turn", "part", "role", "text", F.concat(F.lit("<s>["), name, F.lit("]")).alias("head"), escape(F.col("text")).alias("body"),
        F.concat(F.lit("[/"), F.substring_index(name, "=", 1), F.lit("]</s>")).alias("tail"),
    ).withColumn("full", F.concat("head", "body", "tail"))
    placed = turns.withColumn("n", F.row_number().over(by_turn)).withColumn(
        "at", F.coalesce(F.sum(F.length("full")).over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    return (
        placed.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("n", "full"))).alias("t"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
        .select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.col("t")["full"], "").alias("formatted"), "loss_spans")
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), by the template alone."""
    def turn(piece: Column) -> Column:
        name = F.substring_index(F.substr(piece, F.lit(5)), "]", 1)
        role = F.when(name == "INST", "user").when(name == "RESP", "assistant").when(name == "ROLE", "").otherwise(unescape(F.substr(name, F.lit(6))))
        start = F.length(name) + 6
        text = F.substr(piece, start, F.length(piece) - start + 1 - F.length(F.substring_index(name, "=", 1)) - 3)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, "</s>"), lambda p: p != ""), turn)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Each row of a conversation table as the one event of its message; repeated turns are parts."""
    twins = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return (
        conversations.select("conv_id", "turn", "role", "text").repartition(F.col("conv_id"))
        .withColumn("part", F.row_number().over(twins)).withColumn("seq", F.lit(0)).withColumn("kind", F.lit("message"))
    )


def digests(rendered: DataFrame) -> DataFrame:
    """What a reader of the output sees: turns, counted and hashed, and the text under the loss mask, unescaped."""
    said = F.col("turns")
    masked = lambda span: unescape(F.substr(F.col("formatted"), (span["start"] + 1).cast("int"), span["length"].cast("int")))
    return (
        rendered.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", F.array_join(F.transform("loss_spans", masked), ""))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def _sql_escape(x: str) -> str:
    out = f"replace(coalesce({x}, ''), '\\', '\\e')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{('\\l' if c[0] == '<' else '\\b') + c[1:]}')"
    return out


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, CASE role WHEN 'user' THEN 'INST' WHEN 'assistant' THEN 'RESP' WHEN '' THEN 'ROLE'
    ELSE 'ROLE=' || replace({_sql_escape('role')}, ']', '\\r') END AS tag, {_sql_escape('text')} AS body FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<s>[' || tag || ']' || body || '[/' || split_part(tag, '=', 1) || ']</s>')) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
    formatted_chars::BIGINT AS formatted_chars FROM g
"""
