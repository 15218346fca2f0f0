"""Data quality: observed sessions, absences, completeness, blocking events, cross-checks of two sources, action reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import ratio
from barloom.operators.features import by_day
from barloom.operators.temporal import islands


def absences(bars: DataFrame, sessions: DataFrame, least: int = 20) -> DataFrame:
    """(instrument, last_traded, resumed, missed): bars that come after `least` missed sessions or more."""
    rows = bars.select("instrument", "trade_date").join(F.broadcast(sessions), "trade_date")
    missed = F.col("session") - F.lag("session").over(by_day()) - 1
    return rows.select("instrument", F.lag("trade_date").over(by_day()).alias("last_traded"), F.col("trade_date").alias("resumed"), missed.alias("missed")).where(F.col("missed") >= least)


def observed_sessions(bars: DataFrame, breadth: float = 0.1) -> DataFrame:
    """(trade_date, present, active, is_session): a day counts if enough of the instruments whose span covers it traded.

    Active instruments are a running sum of span starts and ends over days, not a join of days with spans.
    """
    span = bars.groupBy("instrument").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    steps = span.select(F.col("a").alias("day"), F.lit(1).alias("s"), F.lit(0).alias("p")).unionByName(span.select(F.date_add("b", 1).alias("day"), F.lit(-1).alias("s"), F.lit(0).alias("p")))
    days = bars.groupBy(F.col("trade_date").alias("day")).agg(F.count("*").alias("p")).select("day", F.lit(0).alias("s"), "p")
    per = steps.unionByName(days).groupBy("day").agg(F.sum("s").alias("s"), F.sum("p").alias("present"))
    active = F.sum("s").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    out = per.select(F.col("day").alias("trade_date"), "present", active.alias("active")).where("present > 0")
    return out.withColumn("is_session", ratio(F.col("present"), F.col("active")) >= breadth)


def completeness(bars: DataFrame, sessions: DataFrame, thin: float = 0.5) -> DataFrame:
    """Per instrument between its first and last bar: expected, present and missing sessions, missing runs, verdict."""
    have = bars.select("instrument", "trade_date").join(F.broadcast(sessions), "trade_date").select("instrument", "session")
    span = have.groupBy("instrument").agg(F.min("session").alias("a"), F.max("session").alias("b"), F.count("*").alias("present"))
    want = span.select("instrument", F.explode(F.sequence("a", "b")).alias("session"))
    runs = islands(want.join(have, ["instrument", "session"], "left_anti"), ["instrument"], "session").groupBy("instrument").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))
    out = span.join(runs, "instrument", "left").select("instrument", (F.col("b") - F.col("a") + 1).alias("expected"), "present", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("longest", F.lit(0)).alias("longest"))
    share = F.col("present") / F.col("expected")
    return out.withColumn("verdict", F.when(share < thin, "UNVERIFIED").when(F.col("runs") == 0, "COMPLETE").otherwise("GAPS"))


def gate(bars: DataFrame, events: DataFrame, lifetime: int = 253) -> DataFrame:
    """(instrument, trade_date, blocked): a bar is blocked while fewer than lifetime bars have passed since an event(instrument, trade_date)."""
    rows = bars.select("instrument", "trade_date").join(events.select("instrument", "trade_date", F.lit(True).alias("hit")).distinct(), ["instrument", "trade_date"], "left")
    n = F.row_number().over(by_day())
    rows = rows.withColumn("n", n).withColumn("at", F.when(F.col("hit"), F.col("n")))
    last = F.max("at").over(by_day().rowsBetween(W.unboundedPreceding, 0))
    return rows.select("instrument", "trade_date", F.coalesce(F.col("n") - last < lifetime, F.lit(False)).alias("blocked"))


def crosscheck(ours: DataFrame, theirs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Steps of the log ratio of two close series on common days: REVERSING if the next step undoes it, else LEVEL; and where days are missing.

    A step back behind a reversing one is part of it and left out.
    """
    both = ours.select("instrument", "trade_date", F.log("close").alias("x")).join(theirs.select("instrument", "trade_date", F.log("close").alias("y")), ["instrument", "trade_date"])
    w = by_day()
    rows = both.withColumn("r", F.col("x") - F.col("y")).withColumn("step", F.col("r") - F.lag("r").over(w))
    big = F.coalesce(F.abs("step") > tolerance, F.lit(False))
    rows = rows.withColumn("big", big).withColumn("next", F.lead("step").over(w)).withColumn("prev", F.lag("step").over(w)).withColumn("prev_big", F.coalesce(F.lag("big").over(w), F.lit(False)))
    undone = F.coalesce(F.abs(F.col("step") + F.col("next")) <= tolerance, F.lit(False))
    undoes = F.col("prev_big") & (F.abs(F.col("step") + F.col("prev")) <= tolerance)
    return rows.where(F.col("big") & ~undoes).select("instrument", "trade_date", "step", F.when(undone, "REVERSING").otherwise("LEVEL").alias("kind"))


def reconcile(first: DataFrame, second: DataFrame, manual: DataFrame, as_of: str, grace_days: int = 5) -> DataFrame:
    """One row per (instrument, kind, ex_date) of two feeds and hand entries(num, den): state, factor ratio and what differs.

    Hand entries win. Both feeds: CONFIRMED if the ratios are the same when multiplied crosswise, else CONFLICT. The first alone is
    PENDING for the grace days and CONFLICT behind them; the second alone is CONFLICT.
    """
    key = ["instrument", "kind", "ex_date"]
    tag = lambda df, s: df.select(*key, F.lit(s).alias("src"), "num", "den")
    rows = tag(first, "1").unionByName(tag(second, "2")).unionByName(tag(manual, "m"))
    of = lambda s, c: F.max(F.when(F.col("src") == s, F.col(c)))
    g = rows.groupBy(*key).agg(*[of(s, c).alias(f"{c}_{s}") for s in "12m" for c in ("num", "den")])
    one, two, hand = (F.col(f"num_{s}").isNotNull() for s in "12m")
    same = F.col("num_1") * F.col("den_2") == F.col("num_2") * F.col("den_1")
    late = F.datediff(F.lit(as_of).cast("date"), "ex_date") > grace_days
    state = F.when(hand, "MANUAL").when(one & two, F.when(same, "CONFIRMED").otherwise("CONFLICT")).when(one, F.when(late, "CONFLICT").otherwise("PENDING")).otherwise("CONFLICT")
    why = F.when(hand, None).when(one & two & ~same, "RATIO").when(one & ~two & late, "SECOND_MISSING").when(two & ~one, "FIRST_MISSING")
    return g.select(*key, state.alias("state"), why.alias("differs"), F.coalesce("num_m", "num_1", "num_2").alias("num"), F.coalesce("den_m", "den_1", "den_2").alias("den"))


def rights_factor(prior_close, num, den, price):
    """Theoretical ex-rights price by the close before: (den * close + num * price) / ((num + den) * close); null if no discount is left."""
    f = (den * prior_close + num * price) / ((num + den) * prior_close)
    return F.when((price > 0) & (prior_close > 0) & (f < 1) & (f > 0.02), f)


def median_over(c: str, frame):
    """The exact median of a framed window; Spark's own median takes no frame. Frames are a few rows."""
    a = F.array_sort(F.collect_list(c).over(frame))
    k = F.size(a)
    return F.when(k > 0, (F.get(a, F.floor((k - 1) / 2).cast("int")) + F.get(a, F.floor(k / 2).cast("int"))) / 2)


def triage(jumps: DataFrame, bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume medians of n bars before and after each jump, and the level n bars later against the close before."""
    w = by_day()
    rows = bars.select(
        "instrument", "trade_date", median_over("volume", w.rowsBetween(-n, -1)).alias("volume_before"), median_over("volume", w.rowsBetween(1, n)).alias("volume_after"),
        (F.lead("close", n).over(w) / F.lag("close").over(w)).alias("level_later"),
    )
    return jumps.join(rows, ["instrument", "trade_date"])


def volume_scores(bars: DataFrame) -> DataFrame:
    """Up-day volume by down-day volume over 50 bars (10 without down volume), and high-volume down days in 25."""
    w = by_day()
    rows = bars.select("instrument", "trade_date", "close", "volume", F.lag("close").over(w).alias("pc"), F.avg("volume").over(w.rowsBetween(-50, -1)).alias("base"), F.count("volume").over(w.rowsBetween(-50, -1)).alias("k"), F.row_number().over(w).alias("n"))
    last = lambda m: w.rowsBetween(-(m - 1), 0)
    up, down = F.sum(F.when(F.col("close") > F.col("pc"), F.col("volume")).otherwise(0.0)).over(last(50)), F.sum(F.when(F.col("close") < F.col("pc"), F.col("volume")).otherwise(0.0)).over(last(50))
    heavy = F.when((F.col("close") < F.col("pc")) & (F.col("volume") > 1.1 * F.col("base")), 1).otherwise(0)
    sound = F.min("volume").over(last(50)) > 0
    ud = F.when((F.col("n") > 50) & sound, F.when(down > 0, up / F.when(down > 0, down)).when(up > 0, 10.0))
    return rows.select("instrument", "trade_date", ud.alias("up_down"), F.when(F.col("n") >= 76, F.sum(heavy).over(last(25))).alias("distribution_days"))
