"""Breakouts tracked from day to day: one event for each base of an instrument, and the status that follows from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.features import by_day
from barloom.operators.runs import Extremes, by_instrument, picked

DETECTION = "instrument long, trade_date date, base_start date, level double, level_date date, pivot double, pivot_date date, close double, ratio double, state string"
TRACKED = "instrument long, trade_date date, base_start date, status string, event_id string, is_new boolean, source string, breakout_date date, event_pivot double, event_ratio double"


def daily_detections(bars: DataFrame, span: int = 50, settle: int = 5, fall_pct: float = 30.0) -> DataFrame:
    """DETECTION rows: as of each bar, the highest high of `span` bars that ended `settle` bars ago is the base's level, that of the bars since its pivot.

    Of equal highs the earliest counts. ratio is the volume over the mean of the 50 bars before. state is INVALIDATED once the
    close is fall_pct or more under the level, BREAKOUT where the close is above it on half as much volume again, else FORMING.
    Bars too early for a whole span have no row; a NaN is a missing number.
    """
    rows = bars.select("instrument", "trade_date", *[F.col(c).cast("double").alias(c) for c in ("high", "close", "volume")], F.row_number().over(by_day()).alias("n"))
    return by_instrument(rows, lambda table: detections_of(table, span, settle, fall_pct), DETECTION.replace("instrument long", f"instrument {bars.schema['instrument'].dataType.simpleString()}"))


def detections_of(table: pa.Table, span: int, settle: int, fall_pct: float, past: int = 50) -> pa.Table:
    """The rows of daily_detections() of a table of bars of whole instruments in order, numbered within them from 1."""
    number = lambda c: table[c].combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)
    high, close, volume, before = number("high"), number("close"), number("volume"), table["n"].to_numpy() - 1
    upto = np.concatenate([[0], np.cumsum(np.isnan(high))])
    at = np.flatnonzero(before >= span + settle)
    at = at[upto[at - settle] == upto[at - settle - span]]
    total = np.zeros(len(high))
    for k in range(past, 0, -1):
        total[past:] += volume[past - k : len(high) - k]
    mean = np.where((before >= past) & (total > 0), total / past, np.nan)
    ratio = (volume / mean)[at]
    top = Extremes(np.nan_to_num(high, nan=-np.inf), span)
    base = top.place(at - settle - span, at - settle) if len(at) else at
    pivot = top.place(at - settle, at) if len(at) and settle else base
    no_pivot = np.isnan(high[pivot]) if settle else np.ones(len(at), bool)
    level = high[base]
    state = np.where(close[at] <= level * (1 - fall_pct / 100), 0, np.where((close[at] > level) & (ratio >= 1.5), 1, 2))
    day = lambda n, mask=None: table["trade_date"].combine_chunks().take(pa.array(n, mask=mask))
    columns = [
        table["instrument"].combine_chunks().take(pa.array(at)), day(at), day(base), pa.array(level), day(base), pa.array(high[pivot], mask=no_pivot), day(pivot, no_pivot), table["close"].combine_chunks().take(pa.array(at)),
        pa.array(ratio, mask=np.isnan(ratio)), picked(("INVALIDATED", "BREAKOUT", "FORMING"), state),
    ]
    return pa.table(columns, names=[c.split()[0] for c in DETECTION.split(", ")])


def event_id(instrument: Column, base_start: Column, config: str) -> Column:
    """The name of a base's event under a configuration."""
    return F.concat(F.lit("bo-"), F.substring(F.sha2(F.concat_ws("|", instrument.cast("string"), base_start.cast("string"), F.lit(config)).cast("binary"), 256), 1, 20))


def track_breakouts(detections: DataFrame, config: str = "default", volume_ratio: float = 1.5) -> DataFrame:
    """TRACKED rows of detections, one for each that is no INVALIDATED one; see DETECTION.

    A base's event is its first day with a breakout above its level, or with a close above the pivot of the instrument's detection
    before, if that was of the same base, on volume. On its day the detection's own breakout goes before the pivot of the
    day before. From then on the base's status is BREAKOUT while the close is at the event's pivot or above, else FAILED; before
    that it is the detection's. Null closes, levels and ratios break nothing; of repeated days any one should be given.
    """
    last = F.lag(F.struct("base_start", "pivot", "pivot_date")).over(by_day())
    rows = detections.withColumn("last", last)
    above = (F.col("last.base_start") == F.col("base_start")) & F.col("last.pivot_date").isNotNull() & (F.col("close") > F.col("last.pivot")) & (F.col("ratio") >= volume_ratio)
    rows = rows.where("state <> 'INVALIDATED'").withColumn("source", F.when((F.col("state") == "BREAKOUT") & F.col("level").isNotNull(), "STRUCTURAL").when(above, "PRIOR_DAY_PIVOT"))
    hit = F.when(F.col("source").isNotNull(), F.struct("trade_date", "source", F.when(F.col("source") == "STRUCTURAL", F.col("level")).otherwise(F.col("last.pivot")).alias("pivot"), "ratio"))
    of_base = W.partitionBy("instrument", "base_start").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("e", F.first(hit, ignorenulls=True).over(of_base))
    status = F.when(F.col("e").isNull() | ((F.col("e.trade_date") == F.col("trade_date")) & (F.col("e.source") == "STRUCTURAL")), F.col("state")).when(F.col("close") >= F.col("e.pivot"), "BREAKOUT").otherwise("FAILED")
    new = F.coalesce(F.col("e.trade_date") == F.col("trade_date"), F.lit(False))
    return rows.select(
        "instrument", "trade_date", "base_start", status.alias("status"), F.when(F.col("e").isNotNull(), event_id(F.col("instrument"), F.col("base_start"), config)).alias("event_id"), new.alias("is_new"),
        F.col("e.source").alias("source"), F.col("e.trade_date").alias("breakout_date"), F.col("e.pivot").alias("event_pivot"), F.col("e.ratio").alias("event_ratio"),
    )
