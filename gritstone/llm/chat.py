"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log of events is partitioned by conversation and message and sorted by sequence: ``open`` starts a message with a role
and a text, ``delta`` appends to it, ``edit`` replaces its text, and ``regenerate`` starts it anew, after which only
later events count. Final messages are rendered in the order of their turns as
``<|im_start|>role\\ntext<|im_end|>\\n``.

Escaping is reversible: in roles and texts each ``<``, any backslashes, ``|`` gets one more backslash, so the marks occur
only where the template writes them; in roles a backslash becomes ``\\s`` and a line feed ``\\n`` besides. The loss mask is
the list of assistant texts' ranges in the formatted string.

A conversation's string is one value, so a conversation is gathered in one task; its messages and deltas are summed
and ordered by windows, which spill.

Cases: null texts and roles are empty; rows with a null conv_id are one conversation; rows of equal turn are ordered by
role and text and all kept; a log without events of a message gives no message. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ._shared import Scratch, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CLOSE_PATTERN = r"<\|im_end\|>\n"
HARD = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: final messages of a log of conv_id, turn, seq, event, role, text.

    Events of a message follow each other by seq, those of equal seq by event and text. The last open, edit or
    regenerate event restarts its text; the deltas after it append to it. The role is the last that an event names.
    """
    own = Win.partitionBy("conv_id", "turn")
    starts = F.col("event").isin("open", "edit", "regenerate")
    rows = events.select("conv_id", "turn", "seq", "event", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.row_number().over(own.orderBy("seq", "event", "text")))
    rows = rows.withColumn("restart", F.max(F.when(starts, F.col("part"))).over(own))
    live = F.col("restart").isNull() | (F.col("part") >= F.col("restart"))
    return rows.groupBy("conv_id", "turn").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("part"))).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(live, F.struct("part", "text")))), lambda x: x["text"]), "").alias("text"),
    )


def replay(messages: DataFrame) -> DataFrame:
    """A log whose final messages are these (conv_id, turn, role, text): drafts, streamed deltas, edits and regenerations.

    Every third message is streamed in two deltas, every third is a wrong draft with a delta and then regenerated in
    parts, and every third is opened with another text and edited.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    start, rest = text.substr(F.lit(1), half), text.substr(half + 1, F.char_length(text))
    event = lambda seq, name, said, role=F.lit(None).cast("string"): F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("event"), role.alias("role"), said.alias("text"))
    streamed = F.array(event(0, "open", F.lit(""), F.col("role")), event(1, "delta", start), event(2, "delta", rest))
    again = F.array(event(0, "open", F.lit("draft "), F.col("role")), event(1, "delta", start), event(2, "regenerate", start), event(3, "delta", rest))
    edited = F.array(event(0, "open", F.lit("typo"), F.col("role")), event(1, "edit", text))
    log = F.when(F.pmod("turn", F.lit(3)) == 0, streamed).when(F.pmod("turn", F.lit(3)) == 1, again).otherwise(edited)
    return messages.select("conv_id", "turn", F.explode(log).alias("e")).select("conv_id", "turn", "e.seq", "e.event", "e.role", "e.text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask (ranges start, length of assistant texts, by code points from 1). messages: conv_id, turn, role, text."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Win.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    whole = F.char_length("head") + F.char_length("body") + len(CLOSE)
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("ahead", F.coalesce(F.sum(whole).over(order.rowsBetween(Win.unboundedPreceding, -1)), F.lit(0)))
    begin = F.col("ahead") + F.char_length("head") + 1
    span = F.when(F.col("role") == "assistant", F.struct(begin.alias("start"), F.char_length("body").cast("long").alias("length")))
    piece = F.concat("head", "body", F.lit(CLOSE))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("mask"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, place, role, text, loss: messages read back from formatted and mask."""
    pieces = F.split("formatted", CLOSE_PATTERN)
    rows = formatted.select("conv_id", F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("place", "piece"))
    order = Win.partitionBy("conv_id").orderBy("place").rowsBetween(Win.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum(F.char_length("piece") + len(CLOSE)).over(order), F.lit(0)))
    head = F.substring_index("piece", "\n", 1)
    rows = rows.withColumn("start", F.col("ahead") + F.char_length(head) + 2)
    spans = formatted.select(F.col("conv_id").alias("c"), F.explode("mask").alias("m")).select("c", F.col("m.start").alias("s"), F.col("m.length").alias("n"))
    rows = rows.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("start") == F.col("s")), "left")
    text = F.expr("substring(piece, char_length(substring_index(piece, '\\n', 1)) + 2)")
    loss = F.when(F.col("n").isNotNull(), F.expr("substring(piece, char_length(substring_index(piece, '\\n', 1)) + 2, cast(n as int))"))
    return rows.select("conv_id", "place", unescape_role(F.substring(head, len(OPEN) + 1, 1 << 30)).alias("role"), unescape(text).alias("text"), unescape(loss).alias("loss"))


def digests(formatted: DataFrame) -> DataFrame:
    messages = parse(formatted)
    turn = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    by = messages.groupBy(F.col("conv_id").alias("c")).agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", turn.alias("turn")))), lambda x: x["turn"]), "").alias("turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("place", "loss")))), lambda x: x["loss"]), "").alias("loss"),
    )
    out = formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars")).join(by, F.col("conv_id").eqNullSafe(F.col("c")))
    return out.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    scratch = Scratch(spark, "chat")
    # Rows of one turn are messages of their own: each is message number `turn` of its place among equals.
    rows = logged.unionByName(hard)
    place = F.row_number().over(Win.partitionBy("conv_id").orderBy("turn", "role", "text"))
    messages = rows.select("conv_id", place.alias("turn"), "role", "text")
    return digests(scratch.save(render(reconstruct(replay(messages))), "formatted"))


_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"
ORACLE = f"""
WITH m AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{HARD}' UNION ALL SELECT -1, 1, 'assistant', '{HARD}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  COALESCE(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len(OPEN) + 1 + len(CLOSE)})::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
