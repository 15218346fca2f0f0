"""Rolling features, weekly bars, true range and calendar ranks: windows over one instrument's own bars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.frames import Frames, each, greatest, ratio, with_frames


def by_day() -> W:
    return W.partitionBy("instrument").orderBy("trade_date")


def feature_columns(f: Frames) -> None:
    """Averages, extremes, range, volume and volatility of each bar."""
    high, low, close, volume = (f[c] for c in ("high", "low", "close", "volume"))
    before = f.lag(close, 1)
    far = lambda a, b: each(lambda x, y: np.abs(x - y), a, b)
    ranges = greatest(each(np.subtract, high, low), far(high, before), far(low, before))
    steps = f.put("daily_return", ratio(each(np.subtract, close, before), before))
    ranges = f.put("true_range", (ranges[0], ranges[1] & before[1]))
    atr = f.put("atr_14", f.mean(ranges, 14, every=True))
    f.put("atr_pct_14", each(lambda x: x * 100, ratio(atr, close)))
    for n in (20, 50, 150, 200):
        f.put(f"sma_{n}", f.mean(close, n))
    for name, x in (("high", high), ("low", low)):
        for n in (20, 50, 252):
            f.put(f"{name}_{n}", f.extreme(x, n, lowest=name == "low"))
    for n in (5, 10, 20, 50):
        f.put(f"volume_avg_{n}", f.mean(volume, n))
    for n in (20, 50):
        f.put(f"volume_ratio_{n}", ratio(volume, f.lag(f.mean(volume, n, every=True), 1)))
    for n in (20, 50):
        f.put(f"volatility_{n}", f.deviation(steps, n))


def daily_features(bars: DataFrame) -> DataFrame:
    """One row per bar: averages, extremes, range, volume and volatility features, null until their window is full.

    All frames are taken in one pass over an instrument's bars, so the plan has one shuffle and one sort. Volume ratios divide by the
    mean of the bars before the day. The first bar has neither return nor true range.
    """
    return with_frames(bars, feature_columns)


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Monday weeks: first open, extremes, last close, summed volume; week_end is the last day of trade."""
    week = F.date_trunc("week", "trade_date").cast("date")
    return bars.groupBy("instrument", week.alias("week_start")).agg(
        F.max("trade_date").alias("week_end"), F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "trade_date").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_days"),
    )


def swings(bars: DataFrame, left: int = 5, right: int = 5) -> DataFrame:
    """Centred extremes: a bar whose high (low) no bar from `left` before to `right` after exceeds (undercuts).

    (instrument, trade_date, kind, price, confirmed_on): known only `right` bars later; the right edge is pending and left out,
    and so is the left edge. A bar that is both gives two rows. A row is known at a date if confirmed_on is not after it.
    """
    w = by_day()
    around = w.rowsBetween(-left, right)
    rows = bars.select(
        "instrument", "trade_date", "high", "low", F.lead("trade_date", right).over(w).alias("confirmed_on"), F.row_number().over(w).alias("n"),
        F.max("high").over(around).alias("top"), F.min("low").over(around).alias("bottom"),
    ).where(F.col("confirmed_on").isNotNull() & (F.col("n") > left))
    kinds = F.array(
        F.when(F.col("high") == F.col("top"), F.struct(F.lit("HIGH").alias("kind"), F.col("high").alias("price"))),
        F.when(F.col("low") == F.col("bottom"), F.struct(F.lit("LOW").alias("kind"), F.col("low").alias("price"))),
    )
    return rows.select("instrument", "trade_date", "confirmed_on", F.inline(F.array_compact(kinds)))
