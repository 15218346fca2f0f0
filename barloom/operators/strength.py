"""Cross-sectional relative strength and the two rank rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import finite, ratio
from barloom.operators.features import by_day

WEIGHTS = {63: 0.4, 126: 0.2, 189: 0.2, 252: 0.2}


def midrank(value: Column, *by: str) -> tuple[Column, Column]:
    """(percentile, population) within a group, ties in their middle: (below + (equal - 1) / 2) / (N - 1), 1 where alone.

    Null values have neither. Nulls form a partition of their own, so they don't shift the others. All counts share one order, so
    that a group's rows are gone through once.
    """
    ordered = W.partitionBy(*by, value.isNull()).orderBy(value)
    n = F.count(value).over(ordered.rangeBetween(W.unboundedPreceding, W.unboundedFollowing))
    below = F.rank().over(ordered) - 1
    equal = F.count(value).over(ordered.rangeBetween(W.unboundedPreceding, W.currentRow)) - below
    pct = F.when(n == 1, F.lit(1.0)).otherwise((below + 0.5 * (equal - 1)) / F.when(n > 1, n - 1))
    return F.when(value.isNotNull(), pct), F.when(value.isNotNull(), n)


def returns() -> list[Column]:
    """The window returns of a bar that the raw score weighs."""
    return [finite(ratio(F.col("close"), F.lag("close", n).over(by_day())) - 1).alias(f"ret_{n}") for n in WEIGHTS]


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rs_raw, rs_percentile, population, rs_rank 1-99 and rs_status to rows(trade_date, ret_63..ret_252); one shuffle, by day."""
    raw = None
    for n, weight in WEIGHTS.items():
        term = weight * F.col(f"ret_{n}")
        raw = term if raw is None else raw + term
    rows = rows.withColumn("rs_raw", raw)
    pct, population = midrank(F.col("rs_raw"), "trade_date")
    rows = rows.withColumn("rs_percentile", pct).withColumn("population", population)
    return rows.withColumn("rs_rank", (1 + F.floor(98 * F.col("rs_percentile"))).cast("int")).withColumn("rs_status", F.when(F.col("rs_raw").isNull(), "INSUFFICIENT_DATA").otherwise("PASS"))


def relative_strength(bars: DataFrame) -> DataFrame:
    """(instrument, trade_date, ret_63..ret_252, rs_raw, rs_percentile, rs_rank 1-99, population, rs_status) for every bar.

    The raw score weighs four window returns; a row without all four is INSUFFICIENT_DATA and unranked.
    """
    return ranked(bars.select("instrument", "trade_date", *returns()))


def average_rank(value: Column, *by: str) -> Column:
    """Ranks from 1, ties sharing their mean rank."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2
