"""Chat formatting of conversations (DataFrame functions only).

A conversation's turns are collected as structs and sorted, neighbours of the
same role become one block, and the blocks are concatenated::

    <|turn|>role<|text|>first text<|more|>second text<|end|>

Control strings inside roles and texts (these marks, and the marks of other
common templates) get a backslash after their first character; one that has
backslashes there already gets one more.  Taking one away from each restores
the text, and no unescaped mark is left in it.

Defined results: a null role or text counts as empty; turns are ordered by
turn (null first), then role, then text, and repeated rows are all kept; a
null conversation id is a conversation of its own; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
TRAINED_ROLE = "assistant"

# What counts as a control string after its first character.
CONTROL = r"\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _mark(text: str, loss: bool = False) -> Column:
    return F.struct(F.lit(text).alias("text"), F.lit(loss).alias("loss"))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, segments.

    ``segments`` (array of text, loss) is the formatted text in pieces;
    ``loss`` is true on the texts of the trained role and nothing else.
    """
    rows = turns.select(col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    found = found.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (
        F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"])))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns") + 1))
    found = found.withColumn("blocks", F.zip_with("starts", ends, lambda a, b: F.struct(
        F.get("turns", a - 1)["role"].alias("role"), F.slice("turns", a, b - a).alias("turns"))))

    def pieces(block: Column) -> Column:
        def text(turn: Column, i: Column) -> Column:
            own = F.struct(escape(turn["text"]).alias("text"), (block["role"] == TRAINED_ROLE).alias("loss"))
            return F.when(i == 0, F.array(own)).otherwise(F.array(_mark(MORE), own))

        head = F.struct(F.concat(F.lit(TURN), escape(block["role"]), F.lit(TEXT)).alias("text"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), F.flatten(F.transform(block["turns"], text)), F.array(_mark(END)))

    made = found.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_chat(formatted: Column) -> Column:
    """The turns (array of role, text) that a formatted text holds."""
    def block(b: Column) -> Column:
        role = F.substring_index(b, TEXT, 1)
        texts = F.split(F.substr(b, F.length(role) + F.lit(len(TEXT) + 1)), r"<\|more\|>", -1)
        own = unescape(F.substr(role, F.lit(len(TURN) + 1)))
        return F.transform(texts, lambda t: F.struct(own.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, r"<\|end\|>", -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def loss_spans(formatted: DataFrame) -> DataFrame:
    """conv_id, start, end: the spans (code points) of ``formatted`` under the loss mask."""
    each = formatted.select("conv_id", F.posexplode("segments").alias("pos", "segment"))
    each = each.select("conv_id", "pos", F.col("segment.loss").alias("loss"), F.length("segment.text").cast("long").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("pos")
    return each.withColumn("end", F.sum("n").over(upto)).filter("loss").select("conv_id", (F.col("end") - F.col("n")).alias("start"), "end")


ORACLE = r"""
WITH planted(conv_id, turn, role, "text") AS (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS body FROM conversations
  UNION ALL SELECT * FROM planted
),
m AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, body) IS NOT DISTINCT FROM role AS merged,
    length(regexp_replace(body, '([<\[])(\\*)(\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS body_chars,
    length(regexp_replace(role, '([<\[])(\\*)(\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS role_chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(body)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY turn, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN merged THEN 8 ELSE 23 + role_chars END + body_chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
