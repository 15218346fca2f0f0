"""Market health: day-level readings of a whole market, five pillar scores, caps and an exposure light.

A panel of all bars is counted once per day; everything after runs on one row per day (or per sector and day). A reading that
cannot be measured is null, and a null part is left out of its pillar's weighted mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import ladder, ratio
from barloom.operators.market import breadth_measures

#: The weight of each pillar, and of each part in it with its ladder of (reading, points).
PILLARS = {"index_trend": 25, "breadth": 25, "leadership": 20, "accumulation": 15, "breakouts": 15}
PARTS = {
    "index_trend": [("above_50", 20), ("above_150", 20), ("above_200", 20), ("stacked", 20), ("rising_200", 10), ("large_above_50", 5), ("small_above_50", 5)],
    "breadth": [
        ("pct_above_50", 20, [(30, 0), (70, 100)]), ("pct_above_150", 15, [(30, 0), (70, 100)]), ("pct_above_200", 15, [(30, 0), (70, 100)]), ("ad_ratio", 15, [(-0.15, 0), (0.15, 100)]),
        ("highs_lows", 15, [(0.2, 0), (0.8, 100)]), ("above_50_change", 10, [(-15, 0), (15, 100)]), ("own_gap", 10, [(-4, 0), (4, 100)]),
    ],
    "leadership": [
        ("pass_share", 25, [(3, 0), (20, 100)]), ("leader_change", 20, [(-40, 0), (40, 100)]), ("highs_20", 10, [(2, 0), (12, 100)]), ("highs_52", 10, [(0.5, 0), (5, 100)]),
        ("sectors_up", 20, [(20, 0), (80, 100)]), ("leaders_gap", 15, [(-3, 0), (5, 100)]),
    ],
    "accumulation": [
        ("distribution", 30, [(2, 100), (4, 60), (5, 30), (6, 0)]), ("accumulation_days", 20, [(0, 0), (6, 100)]), ("up_down_value", 20, [(0.67, 0), (1.0, 50), (1.5, 100)]),
        ("cluster", 20, [(0, 100), (4, 0)]), ("up_on_volume", 10, [(0.3, 0), (0.7, 100)]),
    ],
    "breakouts": [("success", 30, [(15, 0), (50, 100)]), ("held", 25, [(30, 0), (70, 100)]), ("failure", 20, [(20, 100), (60, 0)]), ("median_return", 15, [(-3, 0), (4, 100)]), ("near_pivot", 10, [(1, 0), (6, 100)])],
}
#: Labels, best first, with their lowest score and the exposure they allow.
LABELS = [("Strong", 80, "full"), ("Constructive", 65, "full"), ("Mixed", 50, "half"), ("Weak", 35, "none"), ("Adverse", 0, "none")]
#: What counts, sectors and breakouts read of the market's panel.
PANEL = (
    "instrument", "trade_date", "high", "low", "close", "volume", "daily_return", "sma_50", "sma_150", "sma_200", "high_20", "high_50", "high_252", "low_252", "volatility_20", "volatility_50", "rs_rank", "status", "eligible",
    "level", "level_before", "volume_before", "close_5", "close_judged", "low_hold", "low_judged", "n_after", "led_on", "led_close",
)
LEADER_RANK, DAY_MOVE, NEAR_GAP, HORIZONS, MIN_SECTORS = 80, 0.002, 0.05, (21, 63, 126), 8


def days() -> W:
    """All days in order; one row each, so a window without a partition key bears it."""
    return W.orderBy("trade_date")


def last(n: int) -> W:
    return days().rowsBetween(-(n - 1), 0)


def whole(agg: Column, what: Column, n: int) -> Column:
    """An aggregate over n days that are all there and have a value; else null."""
    return F.when(F.count(what).over(last(n)) == n, agg.over(last(n)))


def day_counts(panel: DataFrame) -> DataFrame:
    """One row per day of a panel (its PANEL columns): breadth, leaders, volume and the indices.

    What the leaders of 20 bars before made since is counted on the day that their rows name, so a day's bars need not meet those before.
    Instruments with large or small set make two further indices; without these columns those have no return.
    """
    leads = F.coalesce((F.col("status") == "PASS") & (F.col("rs_rank") >= LEADER_RANK), F.lit(False))
    x = panel.withColumns({"leads": leads, "value": F.col("close") * F.col("volume")})
    led = x.where(F.col("leads") & (F.col("close") > 0)).groupBy(F.col("led_on").alias("trade_date")).agg(F.count("*").alias("led_n"), F.avg(F.col("led_close") / F.col("close") - 1).alias("led_return"))
    tight = (F.col("status") == "PASS") & (F.col("close") >= F.col("high_50") * (1 - NEAR_GAP)) & (F.col("volatility_20") < F.col("volatility_50"))
    of = lambda test, c: F.when(F.col("eligible") & test, F.col(c))
    part = lambda c: F.avg(F.when(F.col(c), F.col("daily_return"))) if c in panel.columns else F.lit(None).cast("double")
    days = x.groupBy("trade_date").agg(
        *breadth_measures(), F.count_if(F.col("eligible") & (F.col("high") >= F.col("high_20") * 0.99999)).alias("highs_of_20"), F.count_if("leads").alias("leaders"), F.count_if(tight).alias("near"),
        F.sum(of(F.col("daily_return") > 0, "value")).alias("value_up"), F.sum(of(F.col("daily_return") < 0, "value")).alias("value_down"), F.sum(of(F.lit(True), "volume")).alias("own_volume"),
        F.avg("daily_return").alias("index_return"), F.sum("volume").alias("index_volume"), *[part(c).alias(f"{c}_return") for c in ("large", "small")],
    )
    return days.join(led, "trade_date", "left").withColumn("led_n", F.coalesce("led_n", F.lit(0)))


def sector_days(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sector, trade_date, r): the mean return of each sector's instruments that day."""
    return panel.join(sectors, "instrument").groupBy("sector", "trade_date").agg(F.avg("daily_return").alias("r"))


def sectors_up(lines: DataFrame) -> DataFrame:
    """(trade_date, sectors_up): share of the lines of sector_days() above their 50-day mean with a positive return, averaged over horizons; null below MIN_SECTORS."""
    w = W.partitionBy("sector").orderBy("trade_date")
    line = F.exp(F.sum(F.coalesce(F.log1p("r"), F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = lines.select("sector", "trade_date", line.alias("line"))
    fifty = w.rowsBetween(-49, 0)
    rows = rows.withColumn("mean", F.when(F.count("line").over(fifty) == 50, F.avg("line").over(fifty)))
    rows = rows.select("trade_date", "line", "mean", *[F.lag("line", h).over(w).alias(f"then_{h}") for h in HORIZONS])
    there = [F.col("mean").isNotNull() & F.col(f"then_{h}").isNotNull() for h in HORIZONS]
    up = [F.count_if(t & (F.col("line") > F.col("mean")) & (F.col("line") > F.col(f"then_{h}"))).alias(f"up_{h}") for h, t in zip(HORIZONS, there, strict=True)]
    out = rows.groupBy("trade_date").agg(*up, *[F.count_if(t).alias(f"all_{h}") for h, t in zip(HORIZONS, there, strict=True)])
    shares = sum((F.when(F.col(f"all_{h}") >= MIN_SECTORS, F.col(f"up_{h}") / F.col(f"all_{h}") * 100) for h in HORIZONS), F.lit(0.0))
    return out.select("trade_date", (shares / len(HORIZONS)).alias("sectors_up"))


def judged_breakouts(breakouts: DataFrame, sessions: DataFrame, judge: int = 10, window: int = 20) -> DataFrame:
    """(trade_date, judged, success, held, failure, median_return): breakouts whose verdict fell in the last `window` sessions; each counts on so many days."""
    numbered = sessions.select("trade_date", F.row_number().over(days()).alias("session"))
    at = breakouts.join(numbered, "trade_date").select("*", F.explode(F.sequence(F.col("session") + judge, F.col("session") + (judge + window - 1))).alias("on")).drop("trade_date", "session")
    share = lambda c: F.avg(F.when(F.col(c), 100.0).otherwise(0.0))
    seen = at.groupBy("on").agg(F.count("*").alias("judged"), share("success").alias("success"), share("held").alias("held"), share("failed").alias("failure"), ((F.median("ret_5") + F.median("ret_judged")) / 2).alias("median_return"))
    return seen.join(numbered, seen["on"] == numbered["session"]).drop("on", "session")


def readings(counts: DataFrame, sectors: DataFrame, judged: DataFrame, min_universe: int = 300, min_judged: int = 20) -> DataFrame:
    """One row per day with every reading of the pillars and caps; counts(day_counts), sectors(sectors_up), judged(judged_breakouts)."""
    big = F.col("n") >= min_universe
    x = counts.join(sectors, "trade_date", "left").join(judged, "trade_date", "left").withColumn("big", big)
    upto = days().rowsBetween(W.unboundedPreceding, 0)
    x = x.select(
        "*", F.exp(F.sum(F.when(big, F.coalesce(F.log1p("mean_return"), F.lit(0.0))).otherwise(0.0)).over(upto)).alias("own"), *[F.exp(F.sum(F.coalesce(F.log1p(r), F.lit(0.0))).over(upto)).alias(c) for c, r in (("index", "index_return"), ("large", "large_return"), ("small", "small_return"))],
        F.sum(F.col("advances") - F.col("declines")).over(upto).alias("ad_line"), F.when(big, ratio(F.col("above_50"), F.col("n_50")) * 100).alias("pct_above_50"),
        *[F.when(big, F.col(c) / F.col("n") * 100).alias(f"{k}_pct") for k, c in (("hi_20", "highs_of_20"), ("hi_52", "new_highs"), ("lo_52", "new_lows"))], F.row_number().over(days()).alias("session"),
        *[(F.col(f"{k}_volume") > F.lag(f"{k}_volume").over(days())).alias(f"{k}_heavier") for k in ("own", "index")], (F.lag("big").over(days()) & big).alias("both_big"),
    )
    step = F.col("index") / F.lag("index").over(days()) - 1
    x = x.select(
        "*", F.when(F.col("index_heavier") & (step <= -DAY_MOVE), 1).otherwise(0).alias("index_dist"), F.when(F.col("index_heavier") & (step >= DAY_MOVE), 1).otherwise(0).alias("index_acc"),
        F.when(F.col("own_heavier") & F.col("both_big") & (F.coalesce("mean_return", F.lit(0.0)) <= -DAY_MOVE), 1).otherwise(0).alias("own_dist"),
        *[whole(F.avg("index"), F.col("index"), k).alias(f"index_{k}") for k in (50, 150, 200)], *[whole(F.avg(c), F.col(c), 50).alias(f"{c}_50") for c in ("large", "small")], F.max("index").over(last(252)).alias("index_high"), F.min("ad_line").over(last(252)).alias("ad_low"), F.max("ad_line").over(last(252)).alias("ad_high"),
    )
    total = lambda c, k: F.sum(c).over(last(k))
    ago = lambda c, k: F.lag(c, k).over(days())
    enough = F.col("session") > 25
    acc, dist = F.when(enough, total("index_acc", 25)), F.when(enough, total("index_dist", 25))
    own_dist = F.when(enough & (F.count_if("big").over(last(26)) == 26), total("own_dist", 25))
    mean = lambda c, k: F.when(big, whole(F.avg(c), F.col(c), k))
    hi, lo = mean("hi_52_pct", 10), mean("lo_52_pct", 10)
    flag = lambda t: F.when(t, 100.0).when(~t, 0.0)
    known = F.col("judged") >= min_judged
    return x.select(
        "trade_date", "n", "big", "index", F.col("index_200").alias("index_200"), ago("index_200", 20).alias("index_200_prior"), "index_high", "ad_line",
        flag(F.col("index") > F.col("index_50")).alias("above_50"), flag(F.col("index") > F.col("index_150")).alias("above_150"), flag(F.col("index") > F.col("index_200")).alias("above_200"),
        (flag(F.col("index_50") > F.col("index_150")) / 2 + flag(F.col("index_150") > F.col("index_200")) / 2).alias("stacked"), flag(F.col("index_200") > ago("index_200", 20)).alias("rising_200"), *[F.when(F.count(f"{c}_return").over(upto) > 0, flag(F.col(c) > F.col(f"{c}_50"))).alias(f"{c}_above_50") for c in ("large", "small")],
        "pct_above_50", *[F.when(big, ratio(F.col(f"above_{k}"), F.col(f"n_{k}")) * 100).alias(f"pct_above_{k}") for k in (150, 200)],
        F.when(F.count_if("big").over(last(20)) == 20, ratio(F.sum(F.col("advances") - F.col("declines")).over(last(20)), F.sum(F.col("advances") + F.col("declines")).over(last(20)))).alias("ad_ratio"),
        ratio(hi, hi + lo).alias("highs_lows"), (F.col("pct_above_50") - ago("pct_above_50", 10)).alias("above_50_change"),
        F.when(big & ago("big", 21), (F.col("own") / ago("own", 21) - F.col("index") / ago("index", 21)) * 100).alias("own_gap"),
        F.when(big & (F.col("session") >= 252), ratio(F.col("ad_high") - F.col("ad_line"), F.col("ad_high") - F.col("ad_low"))).alias("ad_line_gap"),
        F.when(big, F.col("n_pass") / F.col("n") * 100).alias("pass_share"), F.when(big, F.col("n_pass")).alias("passes"), F.when(big & ago("big", 10), ago("n_pass", 10)).alias("passes_then"),
        F.when(big & ago("big", 20), (ratio(F.col("leaders"), ago("leaders", 20)) - 1) * 100).alias("leader_change"), mean("hi_20_pct", 10).alias("highs_20"), hi.alias("highs_52"), F.when(big, F.col("sectors_up")).alias("sectors_up"),
        F.when(big & ago("big", 20) & (ago("leaders", 20) > 0) & (F.col("led_n") >= 5), (F.col("led_return") - (F.col("own") / ago("own", 20) - 1)) * 100).alias("leaders_gap"),
        F.coalesce(dist * 0.6 + own_dist * 0.4, dist.cast("double"), own_dist.cast("double")).alias("distribution"), acc.cast("double").alias("accumulation_days"), F.when(big, ratio(total("value_up", 10), total("value_down", 10))).alias("up_down_value"),
        F.when(enough, total("index_dist", 10)).cast("double").alias("cluster"), ratio(acc, acc + dist).alias("up_on_volume"),
        F.when(big, F.coalesce("judged", F.lit(0))).alias("judged"), *[F.when(big & known, F.col(c)).alias(c) for c in ("success", "held", "failure", "median_return")], F.when(big, F.col("near") / F.col("n") * 100).alias("near_pivot"),
        F.when(big, F.col("held")).alias("held_any"), *thrust(),
    )


def thrust(sessions: int = 10) -> list[Column]:
    """The mean share of advances over `sessions` days; see thrust_days for the event."""
    share = ratio(F.col("advances") * 100.0, F.col("advances") + F.col("declines"))
    return [whole(F.avg(share), share, sessions).alias("thrust_ratio")]


def thrust_days(rows: DataFrame, sessions: int = 10, low: float = 40.0, high: float = 61.5) -> DataFrame:
    """Adds thrust: the day on which thrust_ratio first stands above high with a reading below low in the sessions before."""
    before = F.lag("thrust_ratio").over(days())
    fell = F.min("thrust_ratio").over(days().rowsBetween(-sessions, -1)) < low
    return rows.withColumn("thrust", F.coalesce((F.col("thrust_ratio") > high) & (before.isNull() | (before <= high)) & fell, F.lit(False)))


def score(rows: DataFrame, min_judged: int = 20, cap_judged: int = 10) -> DataFrame:
    """(trade_date, the five pillars, raw, raw_label, label, complete, exposure, caps) of readings.

    A pillar is the weighted mean of its parts that could be measured; raw that of the pillars. The index pillar needs all
    three averages, breadth and leadership a market of enough stocks, the breakout pillar enough verdicts. No new highs and lows at all,
    and no days on volume at all, read as neutral. The label is no better than the worst cap that holds.
    """
    index = F.col("above_50").isNotNull() & F.col("above_150").isNotNull() & F.col("above_200").isNotNull()
    gates = {"index_trend": index, "breadth": F.col("big"), "leadership": F.col("big"), "accumulation": F.lit(True), "breakouts": F.coalesce(F.col("judged") >= min_judged, F.lit(False))}
    neutral = {"highs_lows": F.lit(50.0), "up_on_volume": F.when(F.col("accumulation_days").isNotNull(), 50.0)}

    def mean(parts: list[tuple[float, Column]]) -> Column:
        total = sum((F.when(p.isNotNull(), F.lit(float(k))).otherwise(0.0) for k, p in parts), F.lit(0.0))
        return ratio(sum((F.coalesce(p * k, F.lit(0.0)) for k, p in parts), F.lit(0.0)), total)

    for name, parts in PARTS.items():
        points = [(k, F.coalesce(ladder(F.col(c), *steps) if steps else F.col(c), neutral.get(c, F.lit(None)))) for c, k, *steps in parts]
        rows = rows.withColumn(name, F.when(gates[name], mean(points)))
    missing = F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in PILLARS]))
    rows = rows.withColumn("raw", mean([(k, F.col(p)) for p, k in PILLARS.items()])).withColumn("complete", F.size(missing) == 0)
    level = F.when(F.col("raw").isNotNull(), sum((F.when(F.col("raw") < floor, 1).otherwise(0) for _, floor, _ in LABELS[:-1]), F.lit(0)))
    caps = [
        ("downtrend", 3, (F.col("index") < F.col("index_200")) & (F.col("index_200") < F.col("index_200_prior")) & (F.col("pct_above_50") < 30)), ("distribution", 2, F.col("cluster") >= 5),
        ("failures", 3, (F.col("judged") >= cap_judged) & (100 - F.col("held_any") > 60)), ("pass_collapse", 2, 1 - ratio(F.col("passes"), F.col("passes_then")) >= 0.333),
        ("divergence", 1, (F.col("index") >= F.col("index_high") * 0.97) & (F.col("ad_line_gap") > 0.25)), ("incomplete", 2, ~F.col("complete")),
    ]
    hits = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for c, _, t in caps]))
    worst = F.greatest(level, *[F.when(F.coalesce(t, F.lit(False)), k).otherwise(0) for _, k, t in caps])
    name = lambda at, k: F.element_at(F.array(*[F.lit(x[k]) for x in LABELS]), at + 1)
    there = F.col("raw").isNotNull()
    return rows.select(
        "trade_date", *PILLARS, "raw", F.when(there, name(level, 0)).alias("raw_label"), F.when(there, name(worst, 0)).alias("label"), "complete", F.when(there, name(worst, 2)).alias("exposure"),
        F.when(there, F.concat_ws(",", hits)).alias("caps"),
    )
