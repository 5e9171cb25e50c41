"""Chat formatting by Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role become one message whose parts keep their own marks; heads, bodies
and marks are concatenated. Control strings inside texts are escaped so that
the output can be read back exactly. The loss mask is a list of byte spans of
the UTF-8 output, one for each part an assistant said, marks left out.

Edge cases: null texts and roles are empty; turns sort by (turn, role, text),
nulls first, so ties have a fixed order; rows repeated whole are turns of their
own. Rows with a null conv_id form one conversation. Other columns are ignored.
A conversation is one output row, so its size is bounded by that row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import read

START, SAYS, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>"
# Marks of this template and of other common ones.
CONTROLS = [START, SAYS, PART, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LEARNT = "assistant"


def _escaped(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(text: Column) -> Column:
    """Double every backslash, then put one after the first character of a control string.

    Runs of backslashes from the text are even, the one put in stands alone, so
    ``unescape`` can tell them apart.
    """
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(_escaped(c))), CONTROLS, doubled)


def unescape(text: Column) -> Column:
    opened = reduce(lambda t, c: F.replace(t, F.lit(_escaped(c)), F.lit(c)), CONTROLS, text)
    return F.replace(opened, F.lit("\\\\"), F.lit("\\"))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans, n_messages); spans are (start, length) in UTF-8 bytes."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        opening = F.concat(F.when(i > 0, END).otherwise(""), F.lit(START), escape(x["role"]), F.lit(SAYS))
        return F.struct(
            F.when((i > 0) & (before == x["role"]), F.lit(PART)).otherwise(opening).alias("head"),
            escape(x["text"]).alias("body"),
            (x["role"] == LEARNT).alias("learnt"),
        )

    pieces = turns.select("conv_id", F.transform("turns", piece).alias("pieces"))

    def add(state: Column, x: Column) -> Column:
        """Merge a piece into the running offset and the spans so far."""
        begin = state["at"] + F.octet_length(x["head"])
        length = F.octet_length(x["body"])
        span = F.struct(begin.alias("start"), length.alias("length"))
        spans = F.when(x["learnt"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((begin + length).alias("at"), spans.alias("spans"))

    none = F.expr("struct(0 AS at, CAST(array() AS array<struct<start:int,length:int>>) AS spans)")
    whole = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "")
    return pieces.select(
        "conv_id",
        F.concat(whole, F.lit(END)).alias("formatted"),
        F.aggregate("pieces", none, add)["spans"].alias("spans"),
        F.size(F.filter("pieces", lambda x: x["head"] != PART)).alias("n_messages"),
    )


def _split(text: Column, mark: str) -> Column:
    return F.split(text, "\\Q" + mark + "\\E", -1)


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and learnt text recovered from the output and its mask."""

    def turns_of(message: Column) -> Column:
        """Turns of a message, its start mark cut off."""
        head = F.substring_index(message, SAYS, 1)
        body = F.substr(message, F.length(head) + F.lit(len(SAYS) + 1))
        role = unescape(F.substr(head, F.lit(len(START) + 1)))
        return F.transform(_split(body, PART), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    messages = _split(F.col("formatted"), END)
    bounded = F.slice(messages, F.lit(1), F.size(messages) - 1)
    octets = F.col("formatted").cast("binary")
    learnt = F.transform(
        "spans", lambda s: unescape(F.substring(octets, s["start"] + 1, s["length"]).cast("string"))
    )
    return chats.select(
        "*",
        F.flatten(F.transform(bounded, turns_of)).alias("turns"),
        F.array_join(learnt, "").alias("loss_text"),
    )


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests read back from the formatted conversations."""
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(format_chats(rows.unionByName(more))).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        F.col("n_messages").cast("bigint").alias("n_messages"),
    )


def _sql_escape(column: str) -> str:
    quoted = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        quoted = f"replace({quoted}, '{c}', '{_escaped(c)}')"
    return quoted


ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNT}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = '{LEARNT}' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text))
    AS loss_sha256,
  CAST(sum(length({_sql_escape('text')}) + CASE WHEN role = before THEN {len(PART)}
    ELSE {len(START) + len(SAYS) + len(END)} + length({_sql_escape('role')}) END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE before IS NULL OR role <> before) AS n_messages
FROM marked GROUP BY conv_id
"""
