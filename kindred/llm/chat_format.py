"""Chat formatting with Spark expressions only.

The rows of a conversation are collected as structs and sorted by turn; adjacent turns of one role are merged under one
header, and the pieces are joined:

    <turn:ROLE>text<join/>text</turn>\\n

A backslash in a text becomes two, and < becomes \\l, so no control string can stand in a text, and each text can be had
back from the output exactly (in a role, > becomes \\g, too). segments has the pieces in order, with the loss mask: the
pieces that are an assistant's texts. formatted is the pieces one after another. All steps are linear in the turns.

Cases: a null text is an empty one, a null role is the empty role. Turns with equal or null numbers are sorted by role
and text, nulls first; repeated rows are turns of their own. Rows without a conv_id make one conversation. An empty
table gives an empty result. Other columns of the input are dropped. A conversation is one row, as long as it may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, CLOSE, END, JOIN = "<turn:", ">", "</turn>\n", "<join/>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """An escaped text has no <, which can stand for the two backslashes while \\l becomes one; then the two swap."""
    held = F.replace(F.replace(text, F.lit("\\\\"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    held = F.replace(held, F.lit("\\l"), F.lit("\\"))
    return F.translate(held, "<\\", "\\<")


def format_chats(rows: DataFrame) -> DataFrame:
    """One row (conv_id, segments, formatted) for each conversation of rows (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.transform("turns", lambda t: t["role"]), 1, n - 1))
    after = F.concat(F.slice(F.transform("turns", lambda t: t["role"]), 2, n - 1), F.array(F.lit(None).cast("string")))
    around = F.zip_with(F.zip_with("turns", before, lambda t, r: F.struct(t.alias("t"), r.alias("r"))), after, lambda x, r: F.struct(x["t"]["role"].alias("role"), x["t"]["text"].alias("text"), x["r"].alias("before"), r.alias("after")))

    def pieces(t: Column) -> Column:
        header = F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit(">"), F.lit("\\g")), F.lit(CLOSE))
        opening = F.when(t["before"] == t["role"], F.lit("")).otherwise(header)
        closing = F.when(t["after"] == t["role"], F.lit(JOIN)).otherwise(F.lit(END))
        body = F.struct(escape(t["text"]).alias("text"), (t["role"] == LEARNT).alias("loss"))
        return F.array(F.struct(opening.alias("text"), F.lit(False).alias("loss")), body, F.struct(closing.alias("text"), F.lit(False).alias("loss")))

    out = chats.withColumn("around", around).select("conv_id", F.flatten(F.transform("around", pieces)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len(OPEN) + 1, 2**31 - 1), CLOSE, 1))
        texts = F.split(F.substring(block, F.locate(CLOSE, block) + F.lit(1), F.lit(2**31 - 1)), JOIN)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_chats(rows.unionByName(added)).withColumn("turns", read_chats(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return out.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
seen AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS same FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
per AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', ''))
    + CASE WHEN same THEN 7 ELSE 15 + length(role) END) AS n FROM seen GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars FROM per
"""
