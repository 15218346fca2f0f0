"""Scores of setups: linear parts between a worst and a best value, and the mean of those that can be measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import clip_linear

#: The value of each part that scores 0, and that which scores 100.
PARTS = {
    "right_side_range_pct": (16.0, 7.0),
    "final_contraction_pct": (13.0, 6.0),
    "base_depth_pct": (34.0, 11.0),
    "above_sma50_pct": (14.0, 1.0),
    "stack_margin_pct": (39.0, 9.0),
    "prior_advance_pct": (170.0, 50.0),
}


def score_of(parts: dict[str, tuple[float, float]] = PARTS) -> Column:
    """The mean of the parts that have a value; null where none has. NaN is no value."""
    points = [F.when(F.col(name).isNotNull() & ~F.isnan(name), clip_linear(F.col(name), worst, best)) for name, (worst, best) in parts.items()]
    known = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in points), F.lit(0))
    return F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in points), F.lit(0.0)), known)


def rescored(signals: DataFrame, parts: DataFrame) -> DataFrame:
    """signals(instrument, trade_date, ...) with score replaced by that of parts(instrument, trade_date, and PARTS), and its rank of the day.

    A signal without parts, or without any value, keeps no score and ranks last; ties go by instrument.
    """
    measured = parts.select("instrument", "trade_date", score_of().alias("_score"))
    rows = signals.drop("score").join(measured, ["instrument", "trade_date"], "left").withColumnRenamed("_score", "score")
    return day_ranked(rows)


def day_ranked(rows: DataFrame) -> DataFrame:
    """rows(instrument, trade_date, score, ...) with day_rank: best score first, none last, ties by instrument."""
    return rows.withColumn("day_rank", F.row_number().over(W.partitionBy("trade_date").orderBy(F.desc_nulls_last("score"), "instrument")))
