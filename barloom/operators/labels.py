"""What came after: forward labels, first hits, trade and equity statistics, rank studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import ratio
from barloom.operators.features import by_day
from barloom.operators.strength import average_rank

HORIZONS = (5, 10, 20, 40, 60)


def forward_labels(bars: DataFrame, level: Column, volume_ratio: float = 1.5) -> DataFrame:
    """Per bar: returns at five horizons, best and worst of 60 bars, breakout above the level within 20 bars, failure within 10 after it.

    A label is null until all its bars are there. A breakout needs volume_ratio times the mean volume of the 50 bars before.
    """
    w = by_day()
    after = lambda n: w.rowsBetween(1, n)
    pct = lambda x: (x / F.col("close") - 1.0) * 100.0
    prior = w.rowsBetween(-50, -1)
    mean = F.when(F.count("volume").over(prior) == 50, F.avg("volume").over(prior))
    rows = bars.withColumn("level", level).withColumn("n", F.row_number().over(w)).withColumn("loud", F.coalesce((mean > 0) & (F.col("volume") >= volume_ratio * mean), F.lit(False)))
    n60 = F.count(F.lit(1)).over(after(60))
    next20 = F.collect_list(F.struct("close", "loud")).over(after(20))
    next30 = F.collect_list("close").over(after(30))
    rows = rows.select(
        "instrument", "trade_date", "close", "level", n60.alias("n_bars"), *[F.when(F.lead("close", h).over(w).isNotNull(), pct(F.lead("close", h).over(w))).alias(f"ret_{h}") for h in HORIZONS],
        F.when(n60 == 60, pct(F.max("high").over(after(60)))).alias("best_60"), F.when(n60 == 60, pct(F.min("low").over(after(60)))).alias("worst_60"), next20.alias("next20"), next30.alias("next30"),
    )
    day = F.array_position(F.transform("next20", lambda x: (x["close"] > F.col("level")) & x["loud"]), True)
    rows = rows.withColumn("breakout_day", F.when(F.col("level").isNotNull() & (day > 0), day.cast("int")))
    rows = rows.withColumn("breakout", F.when(F.col("level").isNull(), None).when(F.col("breakout_day").isNotNull(), True).when(F.size("next20") == 20, False))
    later = F.slice("next30", F.col("breakout_day") + 1, 10)
    failed = F.when(F.col("breakout_day").isNull(), None).when(F.exists(later, lambda c: c < F.col("level")), True).when(F.size(later) == 10, False)
    rows = rows.withColumn("failed", failed)
    done = (F.col("n_bars") == 60) & (F.col("level").isNull() | F.col("breakout").isNotNull()) & (F.col("breakout_day").isNull() | F.col("failed").isNotNull())
    return rows.withColumn("complete", done).drop("next20", "next30")


def first_hit(bars: DataFrame, up: float = 10.0, down: float = 7.0, window: int = 60) -> DataFrame:
    """Per bar, which comes first within the window: the rise, the fall (taken first if both fall on one bar) or neither."""
    w = by_day().rowsBetween(1, window)
    rows = bars.select("instrument", "trade_date", "close", F.collect_list(F.struct("high", "low")).over(w).alias("next"))
    rise = F.array_position(F.transform("next", lambda x: x["high"] >= F.col("close") * (1 + up / 100)), True)
    fall = F.array_position(F.transform("next", lambda x: x["low"] <= F.col("close") * (1 - down / 100)), True)
    rows = rows.select("instrument", "trade_date", rise.alias("rise"), fall.alias("fall"), F.size("next").alias("n_bars"))
    hit = F.when((F.col("fall") > 0) & ((F.col("rise") == 0) | (F.col("fall") <= F.col("rise"))), "DOWN").when(F.col("rise") > 0, "UP").when(F.col("n_bars") == window, "NONE")
    return rows.select("instrument", "trade_date", hit.alias("hit"), F.when(hit == "DOWN", F.col("fall")).when(hit == "UP", F.col("rise")).cast("int").alias("hit_day"))


def trade_stats(trades: DataFrame, *by: str) -> DataFrame:
    """Per group of trades(ret_pct, hold_days): count, win rate, means, median, profit factor (null without losses)."""
    r = F.col("ret_pct")
    win, loss = F.when(r > 0, r), F.when(r <= 0, r)
    return trades.groupBy(*by).agg(
        F.count("*").alias("trades"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(r).alias("avg_ret"), F.median(r).alias("median_ret"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        ratio(F.sum(win), F.when(-F.sum(loss) > 0, -F.sum(loss))).alias("profit_factor"), F.avg("hold_days").alias("avg_hold_days"),
    )


def equity_stats(curve: DataFrame, key: str) -> DataFrame:
    """Per key of curve(key, day, value): total and yearly return, deepest fall from the peak, Sharpe ratio of daily returns."""
    w = W.partitionBy(key).orderBy("day")
    peak = F.max("value").over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = curve.select(key, "day", "value", (F.col("value") / peak - 1).alias("fall"), ratio(F.col("value"), F.lag("value").over(w)).alias("step"))
    out = rows.groupBy(key).agg(F.min_by("value", "day").alias("first"), F.max_by("value", "day").alias("last"), F.datediff(F.max("day"), F.min("day")).alias("days"), F.min("fall").alias("deepest"), F.avg(F.col("step") - 1).alias("mean"), F.stddev_samp(F.col("step") - 1).alias("sd"), F.count("*").alias("n"))
    out = out.where("n > 1")
    return out.select(
        key, ((F.col("last") / F.col("first") - 1) * 100).alias("total_ret"), F.when((F.col("days") > 0) & (F.col("last") > 0), (F.pow(F.col("last") / F.col("first"), 365.25 / F.col("days")) - 1) * 100).alias("cagr"),
        (F.col("deepest") * 100).alias("max_drawdown"), F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt(F.lit(252.0))).alias("sharpe"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k hits in n; null for n = 0."""
    p = ratio(k, n)
    centre, spread = p + z * z / 2 / n, z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n)
    base = 1 + z * z / n
    return F.when(n > 0, (centre - spread) / base), F.when(n > 0, (centre + spread) / base)


def quintiles(rows: DataFrame, score: str, outcome: str, by: str) -> DataFrame:
    """Per fifth of the score within each date (by average rank): count, mean outcome, hit rate."""
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    rank = average_rank(F.col(score), by)
    fifth = F.least(F.lit(5), (1 + F.floor((rank - 0.5) / n * 5)).cast("int"))
    return rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("fifth", fifth).groupBy("fifth").agg(F.count("*").alias("n"), F.avg(outcome).alias("mean_outcome"), F.avg(F.when(F.col(outcome) > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def information_coefficient(rows: DataFrame, score: str, outcome: str, by: str, least: int = 10) -> DataFrame:
    """Rank correlation of score and outcome per date of `least` rows or more."""
    rows = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = rows.select(by, average_rank(F.col(score), by).alias("a"), average_rank(F.col(outcome), by).alias("b"))
    out = ranked.groupBy(by).agg(F.count("*").alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), (F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")).alias("cov"))
    return out.where((F.col("n") >= least) & (F.col("sa") > 0) & (F.col("sb") > 0)).select(by, "n", (F.col("cov") / (F.col("sa") * F.col("sb"))).alias("ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    """One row over all dates: how many, the mean, and its t statistic (null for one date, or if all are the same)."""
    sd = F.stddev_samp("ic")
    return ics.agg(F.count("ic").alias("dates"), F.avg("ic").alias("mean_ic"), F.when(sd > 0, F.avg("ic") / sd * F.sqrt(F.count("ic"))).alias("t_stat"))
