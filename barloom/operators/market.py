"""Market state: a panel of all instruments and sessions, daily breadth, regimes, breakouts judged later, rotation of sectors."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import above, ratio
from barloom.operators.features import weekly_bars
from barloom.operators.frames import Frames
from barloom.operators.trend import screened


@dataclass(frozen=True)
class BreakoutRules:
    base_sessions: int = 10
    volume_ratio: float = 1.4
    hold_sessions: int = 5
    judge_sessions: int = 10
    follow_through: float = 0.05
    hard_fail: float = 0.03


def panel_columns(f: Frames, rules: BreakoutRules, led: int = 20) -> None:
    """Pivots as they stood before each bar, what came after, and the day and close `led` bars later."""
    close = f["close"]
    f.put("level", f.lag(f["high_50"], 1))
    f.put("level_before", f.lag(f["high_50"], rules.base_sessions + 1))
    f.put("volume_before", f.lag(f["volume_avg_50"], 1))
    f.put("close_5", f.lag(close, -5))
    f.put("close_judged", f.lag(close, -rules.judge_sessions))
    f.put("low_hold", f.ahead(close, rules.hold_sessions)[0])
    lowest, seen = f.ahead(close, rules.judge_sessions)
    f.put("low_judged", lowest)
    f.put("n_after", seen)
    f.put_day("led_on", -led)
    f.put("led_close", f.lag(close, -led))


def panel(bars: DataFrame, rules: BreakoutRules = BreakoutRules(), min_price: float = 20.0, since: date | None = None) -> DataFrame:
    """One wide row per bar, or per bar from `since` on: eligibility, trend verdict, pivots, what came after. Later columns read it; it reads bars once."""
    return screened(bars, makers=(partial(panel_columns, rules=rules),), since=since).withColumn("eligible", F.col("close") >= min_price)


def breadth_measures() -> list[Column]:
    """Counts, sums and means of a day of the panel, under conditions."""
    ok = F.col("eligible")
    n = lambda test: F.count(F.when(ok & test, 1))
    means = [x for k in (50, 150, 200) for x in (n(F.col(f"sma_{k}").isNotNull()).alias(f"n_{k}"), n(above(F.col("close"), F.col(f"sma_{k}"))).alias(f"above_{k}"))]
    return [
        F.count(F.when(ok, 1)).alias("n"), *means,
        n(F.col("daily_return") > 0).alias("advances"), n(F.col("daily_return") < 0).alias("declines"),
        n(F.col("high") >= F.col("high_252") * 0.99999).alias("new_highs"), n(F.col("low") <= F.col("low_252") * 1.00001).alias("new_lows"),
        F.count(F.when(F.col("status") == "PASS", 1)).alias("n_pass"), F.count(F.when(F.col("status") != "INSUFFICIENT_DATA", 1)).alias("n_judged"),
        F.sum(F.when(ok & (F.col("daily_return") > 0), F.col("volume"))).alias("up_volume"), F.sum(F.when(ok & (F.col("daily_return") < 0), F.col("volume"))).alias("down_volume"),
        F.avg(F.when(ok, F.col("daily_return"))).alias("mean_return"),
    ]


def breadth(p: DataFrame) -> DataFrame:
    """One row per day with all breadth measures, in one aggregate."""
    return p.groupBy("trade_date").agg(*breadth_measures())


def passing(p: DataFrame) -> DataFrame:
    """The panel's bars that pass the screen, with what breakouts() reads."""
    read = ("instrument", "trade_date", "close", "volume", "status", "eligible", "level", "level_before", "volume_before", "n_after", "low_hold", "low_judged", "close_5", "close_judged")
    return p.where(F.col("status") == "PASS").select(*read)


def breakouts(p: DataFrame, rules: BreakoutRules = BreakoutRules()) -> DataFrame:
    """Closes above a settled 50-bar high on volume, with the verdict of the sessions after: held, success, failed, returns."""
    hit = p.where((F.col("status") == "PASS") & (F.col("level") <= F.col("level_before")) & (F.col("close") > F.col("level")) & (F.col("volume_before") > 0))
    hit = hit.where((F.col("volume") >= rules.volume_ratio * F.col("volume_before")) & (F.col("n_after") == rules.judge_sessions))
    pct = lambda x: (x / F.col("close") - 1) * 100
    return hit.select(
        "instrument", "trade_date", "level", (F.col("low_hold") >= F.col("level")).alias("held"), (F.col("close_judged") >= F.col("level") * (1 + rules.follow_through)).alias("success"),
        (F.col("low_judged") < F.col("level") * (1 - rules.hard_fail)).alias("failed"), pct(F.col("close_5")).alias("ret_5"), pct(F.col("close_judged")).alias("ret_judged"),
    )


def regimes(days: DataFrame, min_share: float = 0.4, min_members: int = 50, window: int = 50) -> DataFrame:
    """Per day: breadth regime (share above the 50-bar mean) and equal-weight index regime (index above its own mean).

    Windows run over days, one row each, after aggregation; a day without a mean return leaves the index as it was.
    """
    w = W.orderBy("trade_date")
    index = F.exp(F.sum(F.coalesce(F.log1p("mean_return"), F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = days.select("trade_date", "n_50", "above_50", index.alias("index"))
    last = w.rowsBetween(-(window - 1), 0)
    mean = F.when(F.count("index").over(last) == window, F.avg("index").over(last))
    on = (F.col("n_50") >= min_members) & F.coalesce(ratio(F.col("above_50"), F.col("n_50")) >= min_share, F.lit(False))
    return rows.select("trade_date", "index", mean.alias("index_mean"), on.alias("breadth_on"), F.coalesce(F.col("index") > mean, F.lit(False)).alias("index_on"))


def long_uptrend(days: DataFrame, run: int = 21) -> DataFrame:
    """(trade_date, long_uptrend): whether the index stood above its mean on each of the `run` sessions before the day.

    days: regimes(). Only sessions before the day are read; too short a history is no uptrend.
    """
    before = W.orderBy("trade_date").rowsBetween(-run, -1)
    return days.select("trade_date", (F.sum(F.col("index_on").cast("int")).over(before) == run).alias("hit")).select("trade_date", F.coalesce("hit", F.lit(False)).alias("long_uptrend"))


def rotation(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Per sector and week: ratio of the sector's mean close change to the market's, against its 10-week mean; 4-week momentum; quadrant.

    Ratio and momentum are both 100 where nothing moves; a sector leads where both are above.
    """
    wk = weekly_bars(bars)
    step = ratio(F.col("close"), F.lag("close").over(W.partitionBy("instrument").orderBy("week_start"))) - 1
    wk = wk.select("instrument", "week_start", step.alias("change")).where("change IS NOT NULL").join(sectors, "instrument")
    per = wk.groupBy("sector", "week_start").agg(F.avg("change").alias("change"))
    market = wk.groupBy("week_start").agg(F.avg("change").alias("market"))
    w = W.partitionBy("sector").orderBy("week_start")
    line = F.exp(F.sum(F.log1p("change") - F.log1p("market")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = per.join(market, "week_start").select("sector", "week_start", line.alias("line"))
    ten = w.rowsBetween(-9, 0)
    rows = rows.withColumn("ratio", F.when(F.count("line").over(ten) == 10, F.col("line") / F.avg("line").over(ten) * 100))
    rows = rows.withColumn("momentum", F.col("ratio") / F.lag("ratio", 4).over(w) * 100)
    quadrant = F.when(F.col("momentum").isNull(), None).when((F.col("ratio") > 100) & (F.col("momentum") > 100), "LEADING").when(F.col("ratio") > 100, "WEAKENING").when(F.col("momentum") > 100, "IMPROVING").otherwise("LAGGING")
    return rows.withColumn("quadrant", quadrant)
