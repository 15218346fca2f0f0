"""The ten-condition trend screen and weekly stages, for all instruments and dates in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import above, change, finite
from barloom.operators import frames
from barloom.operators.features import feature_columns, weekly_bars
from barloom.operators.frames import Frames, Maker, each, with_frames
from barloom.operators.strength import WEIGHTS, ranked


@dataclass(frozen=True)
class TrendRules:
    """Thresholds of the screen."""

    slope_lookback: int = 21
    above_low_pct: float = 25.0
    below_high_pct: float = 25.0
    min_rank: int = 70


#: The conditions in their order, 1 to 10.
CONDITIONS = ("close_above_sma150", "close_above_sma200", "sma150_above_sma200", "sma200_rising", "sma50_above_sma150", "sma50_above_sma200", "close_above_sma50", "above_52w_low", "near_52w_high", "rs_rank_min")


def trend_columns(f: Frames, lookback: int) -> None:
    """The window returns that the raw score weighs, and the 200-bar mean as it stood `lookback` bars before."""
    for n in WEIGHTS:
        f.put(f"ret_{n}", frames.finite(each(lambda x: x - 1, frames.ratio(f["close"], f.lag(f["close"], n)))))
    f.put("sma_200_prior", f.lag(frames.finite(f["sma_200"]), lookback))


def trend_inputs(bars: DataFrame, rules: TrendRules = TrendRules(), own: tuple[Column, ...] = (), makers: tuple[Maker, ...] = (), since: date | None = None, settle: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Per bar: daily features, returns, strength and what the conditions need; only bars from `since` on, which those before are read for.

    All frames of an instrument come first, with more of them by makers, in one shuffle; only the ranks of a day need a second
    one. Windows in own (over the daily features) cost one more. settle adds columns before the ranks.
    """
    f = with_frames(bars, feature_columns, partial(trend_columns, lookback=rules.slope_lookback), *makers, since=since)
    return ranked(settle(f.select("*", *own)))


def sides(rules: TrendRules = TrendRules()) -> list[tuple[Column, Column, Column]]:
    """(measurement, threshold, passed) of each condition; passed is null where a side is missing or no number."""
    c = lambda name: F.col(name) if name == "rs_rank" else finite(F.col(name))
    low, high = c("low_252") * (1 + rules.above_low_pct / 100), c("high_252") * (1 - rules.below_high_pct / 100)
    pairs = [
        (c("close"), c("sma_150")), (c("close"), c("sma_200")), (c("sma_150"), c("sma_200")), (c("sma_200"), c("sma_200_prior")), (c("sma_50"), c("sma_150")),
        (c("sma_50"), c("sma_200")), (c("close"), c("sma_50")), (c("close"), low), (c("close"), high), (c("rs_rank").cast("double"), F.lit(float(rules.min_rank))),
    ]
    return [(m, t, above(m, t) if k < 7 else m >= t) for k, (m, t) in enumerate(pairs)]


def conditions(rules: TrendRules = TrendRules()) -> Column:
    """An array of (condition_id, name, measurement, threshold, passed)."""
    rows = [
        F.struct(F.lit(k).alias("condition_id"), F.lit(name).alias("name"), m.alias("measurement"), t.alias("threshold"), passed.alias("passed"))
        for k, (name, (m, t, passed)) in enumerate(zip(CONDITIONS, sides(rules), strict=True), 1)
    ]
    return F.array(*rows)


def trend_conditions(bars: DataFrame, rules: TrendRules = TrendRules()) -> DataFrame:
    """Long form: ten rows per bar."""
    return trend_inputs(bars, rules).select("instrument", "trade_date", F.inline(conditions(rules)))


def settled(rows: DataFrame, rules: TrendRules) -> DataFrame:
    """Adds how many of the conditions without a rank hold, and whether one is missing; so their prices need not go to the day with its ranks."""
    held = [passed for _, _, passed in sides(rules)[:-1]]
    return rows.select("*", sum(F.coalesce(p.cast("int"), F.lit(0)) for p in held).cast("byte").alias("_n"), reduce(or_, (p.isNull() for p in held)).alias("_missing"))


def screened(bars: DataFrame, rules: TrendRules = TrendRules(), own: tuple[Column, ...] = (), makers: tuple[Maker, ...] = (), since: date | None = None) -> DataFrame:
    """trend_inputs with n_passed and status; any missing condition makes INSUFFICIENT_DATA, all true PASS, else FAIL."""
    rows = trend_inputs(bars, rules, own, makers, since, settle=partial(settled, rules=rules))
    *_, (_, _, strong) = sides(rules)
    status = F.when(F.col("_missing") | strong.isNull(), "INSUFFICIENT_DATA").when((F.col("_n") == len(CONDITIONS) - 1) & strong, "PASS").otherwise("FAIL")
    n = F.col("_n") + F.coalesce(strong.cast("int"), F.lit(0))
    return rows.select(*[c for c in rows.columns if c not in ("_n", "_missing")], n.alias("n_passed"), status.alias("status"))


def trend_status(bars: DataFrame, rules: TrendRules = TrendRules()) -> DataFrame:
    """Per bar: close, rank, n_passed and status of screened."""
    return screened(bars, rules).select("instrument", "trade_date", finite(F.col("close")).alias("close"), "rs_rank", "n_passed", "status")


def weekly_stage(bars: DataFrame, weeks: int = 30, slope_weeks: int = 4, band: float = 0.5, advance: float = 10.0) -> DataFrame:
    """Stage of each bar's date: the weeks completed before it, and its own week closing at its close.

    The average of the current week is that of the weeks-1 completed weeks' closes before and the day's close; the averages
    slope_weeks and weeks ago are of completed weeks only.
    """
    wk = weekly_bars(bars).select("instrument", "week_start", F.col("close").alias("week_close"))
    w = W.partitionBy("instrument").orderBy("week_start")
    back = lambda k, n: w.rowsBetween(-(k + n - 1), -k)
    closes = F.count("week_close").over
    sums = wk.select(
        "instrument", "week_start",
        F.when(closes(back(1, weeks - 1)) == weeks - 1, F.sum("week_close").over(back(1, weeks - 1))).alias("before"),
        F.when(closes(back(slope_weeks, weeks)) == weeks, F.avg("week_close").over(back(slope_weeks, weeks))).alias("sma_slope"),
        F.when(closes(back(weeks, weeks)) == weeks, F.avg("week_close").over(back(weeks, weeks))).alias("sma_prior"),
    )
    rows = bars.select("instrument", "trade_date", "close", F.date_trunc("week", "trade_date").cast("date").alias("week_start")).join(sums, ["instrument", "week_start"])
    rows = rows.withColumn("sma_w", (F.col("before") + F.col("close")) / weeks)
    rows = rows.withColumn("slope_pct", change(F.col("sma_w"), F.col("sma_slope"))).withColumn("prior_pct", change(F.col("sma_slope"), F.col("sma_prior")))
    s, close = F.col("slope_pct"), F.col("close")
    stage = (
        F.when(F.col("sma_w").isNull() | s.isNull(), "INSUFFICIENT_DATA")
        .when((close < F.col("sma_w")) & (s < -band), "STAGE_4")
        .when((close > F.col("sma_w")) & (s > band), "STAGE_2")
        .when(F.abs(s) <= band, F.when(F.col("prior_pct").isNull(), "INSUFFICIENT_DATA").when(F.col("prior_pct") >= advance, "STAGE_3").otherwise("STAGE_1"))
        .otherwise("TRANSITION")
    )
    return rows.select("instrument", "trade_date", "sma_w", "slope_pct", "prior_pct", stage.alias("stage"), (F.weekday("trade_date") < 4).alias("is_partial"))
