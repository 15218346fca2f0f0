"""Setups and breakouts per session, and how many of the recent breakouts have failed by then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def judged_events(events: DataFrame, bars: DataFrame, sessions: DataFrame, within: int = 5) -> DataFrame:
    """(instrument, day, level, known, failed) of events(instrument, day, level) whose result is known: failed on the first close under the level within so many sessions, held once these have passed.

    known is the number of the session on which that is known, so no row says what its session couldn't. An instrument's events of one day
    are one, at the lowest level. Events meet the closes of the sessions behind them by session number, spread over `within`.
    """
    one = events.groupBy("instrument", "day").agg(F.min("level").alias("level"))
    at = one.join(sessions.select(F.col("trade_date").alias("day"), "session"), "day")
    closes = bars.join(sessions, "trade_date").select("instrument", F.col("session").alias("on"), "close")
    spread = at.withColumn("on", F.explode(F.sequence(F.col("session") + 1, F.col("session") + within)))
    below = spread.join(closes, ["instrument", "on"]).where(F.col("close") < F.col("level")).groupBy("instrument", "day").agg(F.min("on").alias("fell"))
    newest = sessions.agg(F.max("session").alias("newest"))
    rows = at.join(below, ["instrument", "day"], "left").crossJoin(F.broadcast(newest))
    known = F.coalesce("fell", F.when(F.col("session") + within <= F.col("newest"), F.col("session") + within))
    return rows.withColumn("known", known).where("known IS NOT NULL").select("instrument", "day", "level", "known", F.col("fell").isNotNull().alias("failed"))


def setup_flow(setups: DataFrame, events: DataFrame, bars: DataFrame, sessions: DataFrame, within: int = 5, window: int = 20, min_judged: int = 5) -> DataFrame:
    """One row for each session from the first scan on: (day, new_setups, breakouts, judged, failed, failed_pct).

    setups(instrument, day): who was set up at each scan. A setup is new if the scan before lacks it; there is no number on the first
    scan's day and on days without a scan. judged and failed count the breakouts whose result became known in the last `window`
    sessions; failed_pct is null below min_judged.
    """
    w = W.orderBy("day")
    scans = setups.select("day").distinct().select("day", F.lag("day").over(w).alias("before"))
    has = setups.select("instrument", "day").distinct()
    fresh = has.join(scans, "day").join(has.withColumnRenamed("day", "before"), ["instrument", "before"], "left_anti").groupBy("day").agg(F.count("*").alias("fresh"))
    per_scan = scans.join(fresh, "day", "left").select("day", F.when(F.col("before").isNotNull(), F.coalesce("fresh", F.lit(0))).alias("new_setups"))
    since = scans.agg(F.min("day").alias("since"))
    later = events.crossJoin(F.broadcast(since)).where(F.col("day") >= F.col("since")).drop("since")
    days = sessions.crossJoin(F.broadcast(since)).where(F.col("trade_date") >= F.col("since")).select(F.col("trade_date").alias("day"), "session")
    broke = later.select("instrument", "day").distinct().groupBy("day").agg(F.count("*").alias("breakouts"))
    known = judged_events(later, bars, sessions, within).groupBy(F.col("known").alias("session")).agg(F.count("*").alias("j"), F.count_if("failed").alias("f"))
    rows = days.join(per_scan, "day", "left").join(broke, "day", "left").join(known, "session", "left")
    last = W.orderBy("session").rowsBetween(-(window - 1), 0)
    total = lambda c: F.coalesce(F.sum(c).over(last), F.lit(0))
    rows = rows.select("day", "new_setups", F.coalesce("breakouts", F.lit(0)).alias("breakouts"), total("j").alias("judged"), total("f").alias("failed"))
    return rows.withColumn("failed_pct", F.when(F.col("judged") >= min_judged, F.col("failed") * 100.0 / F.col("judged")))
