"""Chat formatting by prefix-target expansion.

A conversation is a row of turns; any role but the assistant's is rendered as
``[INST]role<s>text[/INST]`` and the assistant's as ``text</s>``. Each
assistant turn becomes an example: all turns up to it, of which only the
reply's text is trained on. Control strings inside roles and texts get a
backslash after their first character (one more, if they have some already),
so that the text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

OPEN, MID, CLOSE, END = "[INST]", "<s>", "[/INST]", "</s>"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"\[(\\*)(/?INST\])", r"[\\$1$2")
    return F.regexp_replace(c, r"<(\\*)(/?s>)", r"<\\$1$2")


def unescape(c: Column) -> Column:
    c = F.regexp_replace(c, r"\[\\(\\*)(/?INST\])", "[$1$2")
    return F.regexp_replace(c, r"<\\(\\*)(/?s>)", "<$1$2")


def render(role: Column, text: Column) -> Column:
    body = escape(text)
    return F.when(role == ASSISTANT, F.concat(body, F.lit(END))).otherwise(F.concat(F.lit(OPEN), escape(role), F.lit(MID), body, F.lit(CLOSE)))


def expand(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), formatted, loss_start and
    loss_end (code points from 0, the end excluded).

    ``turns`` has conv_id, turn, role, text. Null roles and texts are empty,
    turns with the same number go by role and text, a null number comes first,
    and rows without conv_id are one conversation. Turns after the last reply
    come in a last row with an empty loss, so nothing is lost. A conversation's
    turns meet in one task, as its examples hold them all.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("part", render(F.col("role"), F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("at", F.row_number().over(order)).withColumn("end", F.sum(F.char_length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("last", F.lead("at").over(order).isNull())
    is_reply = F.col("role") == ASSISTANT
    grouped = t.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"),
        F.sort_array(F.collect_list(F.when(is_reply | F.col("last"), F.struct("end", F.when(is_reply, F.char_length("part") - len(END)).otherwise(F.lit(-1)).alias("reply"))))).alias("cuts"),
    )
    whole = grouped.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("whole"), F.posexplode("cuts").alias("example", "cut"))
    end = F.col("cut.end")
    replied = F.col("cut.reply") >= 0
    return whole.select(
        "conv_id", "example", F.substring("whole", F.lit(1), end.cast("int")).alias("formatted"),
        F.when(replied, end - len(END) - F.col("cut.reply")).otherwise(end).cast("long").alias("loss_start"),
        F.when(replied, end - len(END)).otherwise(end).cast("long").alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) that a formatted text holds."""
    parts = F.regexp_extract_all(formatted, F.lit(r"(?s)\[INST\].*?<s>.*?\[/INST\]|.*?</s>"), F.lit(0))

    def turn(p: Column) -> Column:
        asked = p.startswith(OPEN)
        role = F.when(asked, unescape(F.regexp_extract(p, r"(?s)^\[INST\](.*?)<s>", 1))).otherwise(F.lit(ASSISTANT))
        text = F.when(asked, unescape(F.regexp_extract(p, r"(?s)^\[INST\].*?<s>(.*)\[/INST\]$", 1))).otherwise(unescape(F.regexp_extract(p, r"(?s)^(.*)</s>$", 1)))
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(parts, turn)


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: its turns and what is trained on."""
    e = examples.withColumn("loss", unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))")))
    g = e.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    g = g.withColumn("turns", read_turns(F.col("whole")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return g.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op4(spark, sf_dir):
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(own).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(expand(turns))


def op4_sql() -> str:
    esc = lambda c: f"regexp_replace(regexp_replace({c}, '\\[(\\\\*)(/?INST\\])', '[\\\\\\1\\2', 'g'), '<(\\\\*)(/?s>)', '<\\\\\\1\\2', 'g')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER w AS pos, length({esc('text')}) + CASE WHEN role = 'assistant' THEN 4 ELSE 16 + length({esc('role')}) END AS len FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(len) OVER w AS ends, lead(pos) OVER w IS NULL AS is_last FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR is_last THEN ends ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
