"""Joins in time. Each has an equality on the instrument, so none becomes a nested loop over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of the last right row at or before its time (strict: before).

    One union, one sort: the last right row is carried forward. At equal times right rows stand before left ones, or behind if strict.
    Right rows must be unique on key and time.
    """
    tie = F.lit(1 if strict else 0)
    a = left.select("*", F.col(left_time).alias("_t"), (F.lit(1) - tie).alias("_side"), F.lit(None).cast(right.select(F.struct(right_time, *values)).schema[0].dataType).alias("_r"), F.lit(True).alias("_left"))
    cols = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in key else F.col(f.name) for f in left.schema.fields]
    b = right.select(*cols, F.col(right_time).alias("_t"), tie.alias("_side"), F.struct(right_time, *values).alias("_r"), F.lit(False).alias("_left"))
    w = W.partitionBy(*key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_left")
    return out.select(*left.columns, F.col(f"_m.{right_time}").alias(f"matched_{right_time}"), *[F.col(f"_m.{v}").alias(v) for v in values])


def forward(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of the first right row strictly after its time."""
    tie = F.struct(right_time, *values)
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(right.select(tie).schema[0].dataType).alias("_r"), F.lit(True).alias("_left"))
    cols = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in key else F.col(f.name) for f in left.schema.fields]
    b = right.select(*cols, F.col(right_time).alias("_t"), F.lit(-1).alias("_side"), tie.alias("_r"), F.lit(False).alias("_left"))
    w = W.partitionBy(*key).orderBy("_t", "_side").rowsBetween(1, W.unboundedFollowing)
    out = a.unionByName(b).withColumn("_m", F.first("_r", ignorenulls=True).over(w)).where("_left")
    return out.select(*left.columns, F.col(f"_m.{right_time}").alias(f"matched_{right_time}"), *[F.col(f"_m.{v}").alias(v) for v in values])


def spans_over(spans: DataFrame, first: str, last: str) -> DataFrame:
    """(day, n): how many spans cover each day on which some span begins or has ended.

    A span is +1 at its first day and -1 behind its last; a running sum replaces the join of days with spans.
    """
    steps = spans.select(F.col(first).alias("day"), F.lit(1).alias("s")).unionByName(spans.select(F.date_add(last, 1).alias("day"), F.lit(-1).alias("s")))
    per_day = steps.groupBy("day").agg(F.sum("s").alias("s"))
    return per_day.select("day", F.sum("s").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)).alias("n"))
