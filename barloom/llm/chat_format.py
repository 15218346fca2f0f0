"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that participant as the assistant and
all others as named users; only the assistant's words and end mark are targets of the loss mask. A rendered dialogue is
a sequence of segments, one row each with its place in the string, so that a conversation of any length is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "<|end|>\n"


def rotate(turns: DataFrame, system_role: str = "system", block: int = 256) -> DataFrame:
    """(conv_id, perspective, turn, role, seq, segment, target_start, target_end, start, end).

    One row per conversation, participant and turn. segment is the text that the turn adds to that participant's
    rendering; start and end are code points in the whole rendering, end exclusive; target_start and target_end
    mark what counts for the loss and are null where nothing does. Turns of system_role keep that role for all
    and take no perspective of their own; a conversation of system turns alone has no rendering. A null role is the user
    'unknown', a null text is empty; a null conv_id or turn is a value like others, before all. Equal turns are ordered by role and text;
    repeated rows all stay. Other columns are neither read nor returned.
    """
    base = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Long conversations are numbered in blocks of turns: rank within a block, blocks summed, two levels instead of one window.
    base = base.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**63))))
    key = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull()]
    base = base.withColumn("conv_key", F.xxhash64(*key))
    speakers = base.where(F.col("role") != system_role).groupBy("conv_key", "conv_id").agg(F.collect_set("role").alias("speakers"))
    joined = base.join(speakers.select(F.col("conv_key"), F.col("conv_id").alias("other_id"), "speakers"), "conv_key").where(F.col("conv_id").eqNullSafe(F.col("other_id"))).drop("other_id")
    each = joined.select("*", F.explode("speakers").alias("perspective")).drop("speakers")
    own = F.col("role") == F.col("perspective")
    head = F.when(F.col("role") == system_role, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n")))
    each = each.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(END))).withColumn("n", F.char_length("segment").cast("long"))
    inner = W.partitionBy("conv_key", "conv_id", "perspective", "block").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    each = each.select("*", F.sum("n").over(inner).alias("upto"), F.row_number().over(inner).alias("rank"))
    blocks = each.groupBy("conv_key", "conv_id", "perspective", "block").agg(F.sum("n").alias("block_n"), F.count("*").alias("block_rows"))
    outer = W.partitionBy("conv_key", "conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_key").alias("k2"), F.col("conv_id").alias("c2"), F.col("perspective").alias("p2"), F.col("block").alias("b2"),
        F.coalesce(F.sum("block_n").over(outer), F.lit(0)).alias("before_n"), F.coalesce(F.sum("block_rows").over(outer), F.lit(0)).alias("before_rows"),
    )
    same = (F.col("conv_key") == F.col("k2")) & F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("perspective") == F.col("p2")) & (F.col("block") == F.col("b2"))
    out = each.join(blocks, same)
    start = F.col("before_n") + F.col("upto") - F.col("n")
    end = F.col("before_n") + F.col("upto")
    return out.select(
        "conv_id", "perspective", "turn", "role", (F.col("before_rows") + F.col("rank")).cast("long").alias("seq"), "segment",
        F.when(own, start + F.char_length("head")).alias("target_start"), F.when(own, end).alias("target_end"), start.alias("start"), end.alias("end"),
    )


def op3(turns: DataFrame) -> DataFrame:
    return rotate(turns)


SQL = """
WITH b AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM b WHERE role <> 'system'),
e AS (SELECT b.*, p.perspective, b.role = p.perspective AS own,
  CASE WHEN b.role = 'system' THEN '<|system|>' || chr(10) WHEN b.role = p.perspective THEN '<|assistant|>' || chr(10)
       ELSE '<|user name=' || b.role || '|>' || chr(10) END AS head
  FROM b JOIN p ON b.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM e),
n AS (SELECT *, row_number() OVER w AS seq, CAST(sum(length(segment)) OVER w AS BIGINT) AS "end" FROM s
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, role, seq, segment,
  CASE WHEN own THEN "end" - length(segment) + length(head) END AS target_start, CASE WHEN own THEN "end" END AS target_end,
  "end" - length(segment) AS start, "end" FROM n
"""
