"""Chat formatting: multi-party perspective rotation with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turns whose offsets one window task sums; longer dialogues are summed chunk by chunk.
CHUNK_TURNS = 128


def _segment(view: Column, name: Column, text: Column) -> Column:
    head = F.when(view == "user", F.concat(F.lit("<|im_start|>user name="), name)).otherwise(F.concat(F.lit("<|im_start|>"), view))
    return F.concat(head, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def rotate_perspectives(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """Render every dialogue once for each participant, with that speaker as assistant and the others as named users.

    A participant is a distinct role of the conversation that isn't a narrator; narrators' turns appear as system
    messages in every view. Returns one row for each conversation, participant and turn:
    ``conv_id, perspective, position, turn, view_role, name, segment, segment_start, segment_end, mask_start,
    mask_end``. Joining ``segment`` by ``position`` gives the whole rendering; offsets count its characters, and
    [mask_start, mask_end) is what the loss covers: the text and end mark of the assistant's turns (null elsewhere).

    Turns follow in order of turn (null first), role, and the text's MD5; repeated rows stay, side by side. A
    null or blank role is the participant ``unknown``, a null text is empty, rows with a null conversation form one
    conversation. A dialogue of narrators alone has no participant and gives no rows; an empty table gives none.
    Other columns are ignored.

    Offsets are a two-level prefix sum, over chunks of ``CHUNK_TURNS`` turn numbers and then within chunks, so a
    conversation that holds a large part of all rows is not summed or rendered by one task.
    """
    role = F.trim(F.coalesce(F.col(role_col), F.lit("")))
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(role == "", "unknown").otherwise(role).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.floor(F.col(turn_col).cast("long") / CHUNK_TURNS).alias("chunk"),
    )
    speakers = turns.where(~F.col("name").isin(*narrators)).select(F.col("conv_id").alias("of"), F.col("name").alias("perspective")).distinct()
    view = F.when(F.col("name").isin(*narrators), "system").when(F.col("name") == F.col("perspective"), "assistant").otherwise("user")
    rows = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of").withColumn("view_role", view)
    rows = rows.withColumn("segment", _segment(F.col("view_role"), F.col("name"), F.col("text"))).withColumn("size", F.length("segment").cast("long"))

    sums = rows.groupBy("conv_id", "perspective", "chunk").agg(F.sum("size").alias("chunk_size"), F.count("*").alias("chunk_turns"))
    before = W.partitionBy("conv_id", "perspective").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("chunk").alias("k"),
        F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("chunk_start"), F.coalesce(F.sum("chunk_turns").over(before), F.lit(0)).alias("chunk_position"),
    )
    within = W.partitionBy("conv_id", "perspective", "chunk").orderBy(F.col("turn").asc_nulls_first(), "name", F.md5("text"))
    ends = F.sum("size").over(within.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("ends", ends).withColumn("nth", F.row_number().over(within) - 1)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("chunk").eqNullSafe(F.col("k"))
    rows = rows.join(starts, same).withColumn("segment_end", F.col("chunk_start") + F.col("ends"))
    spoken = F.col("view_role") == "assistant"
    return rows.select(
        "conv_id", "perspective", (F.col("chunk_position") + F.col("nth")).cast("long").alias("position"), "turn", "view_role", "name", "segment",
        (F.col("segment_end") - F.col("size")).alias("segment_start"), "segment_end",
        F.when(spoken, F.col("segment_end") - F.length("text") - F.length(F.lit("<|im_end|>\n"))).cast("long").alias("mask_start"),
        F.when(spoken, F.col("segment_end") - 1).cast("long").alias("mask_end"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS name, coalesce(text, '') AS text FROM conversations
), s AS (
  SELECT DISTINCT conv_id AS of, name AS perspective FROM t WHERE name <> 'system'
), v AS (
  SELECT *, CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS view_role
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.of
), r AS (
  SELECT *, CASE WHEN view_role = 'user' THEN '<|im_start|>user name=' || name ELSE '<|im_start|>' || view_role END || chr(10) || text || '<|im_end|>' || chr(10) AS segment FROM v
), w AS (
  SELECT *, row_number() OVER o - 1 AS position, CAST(sum(length(segment)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment_end
  FROM r WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, md5(text))
)
SELECT conv_id, perspective, position, turn, view_role, name, segment, CAST(segment_end - length(segment) AS BIGINT) AS segment_start, segment_end,
  CAST(CASE WHEN view_role = 'assistant' THEN segment_end - length(text) - 11 END AS BIGINT) AS mask_start,
  CAST(CASE WHEN view_role = 'assistant' THEN segment_end - 1 END AS BIGINT) AS mask_end
FROM w
"""
