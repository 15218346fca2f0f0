"""The eligible universe of every month-end at once: statistics of the last bar, rules in order, survivorship of the evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import first_reason
from barloom.operators.features import by_day
from barloom.sources.bars import sessions

#: Series that settle trade by trade.
TRADE_TO_TRADE = ("BE", "BZ")


@dataclass(frozen=True)
class UniverseRules:
    exchange: str = "NSE"
    series: tuple[str, ...] = ("EQ",)
    min_price: float = 20.0
    min_turnover_20: float = 10_000_000.0
    min_turnover_50: float = 10_000_000.0
    min_history: int = 253
    max_missed: int = 5


def months(first: Column, last: Column) -> Column:
    """The month-ends from the month of one date to that of another; from the first of each month, as month-ends don't step evenly."""
    return F.explode(F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH")), F.last_day))


def month_ends(calendar: DataFrame) -> DataFrame:
    """(as_of, session): each month-end from the first to the last session, with the number of the last session by then."""
    span = calendar.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).where("a IS NOT NULL").select(months(F.col("a"), F.col("b")).alias("as_of"))
    seen = calendar.groupBy(F.last_day("trade_date").alias("as_of")).agg(F.max("session").alias("session"))
    return span.join(seen, "as_of", "left").select("as_of", F.max("session").over(W.orderBy("as_of").rowsBetween(W.unboundedPreceding, 0)).alias("session"))


def candidates(bars: DataFrame) -> DataFrame:
    """(instrument, as_of, last_trade, price, series, exchange, turnover_20, turnover_50, history, missed) of each month-end.

    The last bar on or before a month-end speaks for it; it is found by the bar after, so no join on inequalities and no
    product of instruments and dates is made. Turnover is averaged over the bars there are, up to 20 and 50; missed counts
    the market's sessions since. A bar without a volume has no turnover and is left out of the mean.
    """
    w = by_day()
    value = F.col("close") * F.col("volume")
    mean = lambda n: F.avg(value).over(w.rowsBetween(-(n - 1), 0))
    calendar = sessions(bars)
    ends = month_ends(calendar)
    rows = bars.select(
        "instrument", "trade_date", F.col("close").alias("price"), "series", "exchange", mean(20).alias("turnover_20"), mean(50).alias("turnover_50"), F.row_number().over(w).alias("history"), F.lead("trade_date").over(w).alias("next"),
    )
    rows = rows.where(F.col("next").isNull() | (F.last_day("trade_date") < F.col("next")))
    rows = rows.crossJoin(F.broadcast(calendar.agg(F.max("trade_date").alias("horizon"))))
    rows = rows.select("*", months(F.col("trade_date"), F.coalesce("next", "horizon")).alias("as_of")).where(F.col("next").isNull() | (F.col("as_of") < F.col("next")))
    rows = rows.join(calendar.withColumnRenamed("session", "at"), "trade_date").join(ends, "as_of")
    return rows.select("instrument", "as_of", F.col("trade_date").alias("last_trade"), "price", "series", "exchange", "turnover_20", "turnover_50", "history", (F.col("session") - F.col("at")).alias("missed"))


def flagged(found: DataFrame, flags: DataFrame) -> DataFrame:
    """Candidates with asm and gsm: whether such a flag was valid and known on the date. flags: (instrument, flag, valid_from, valid_to, known_from)."""
    live = found.select("instrument", "as_of").join(flags, "instrument").where((F.col("valid_from") <= F.col("as_of")) & (F.col("known_from") <= F.col("as_of")) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("as_of"))))
    per = live.groupBy("instrument", "as_of").agg(*[F.bool_or(F.col("flag") == k).alias(k.lower()) for k in ("ASM", "GSM")])
    return found.join(per, ["instrument", "as_of"], "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("asm", "gsm")})


def snapshot(found: DataFrame, rules: UniverseRules = UniverseRules()) -> DataFrame:
    """Flagged candidates with `eligible` and the first rule that excludes them; a missing value fails the rule that needs it."""
    below = lambda name, least: F.col(name).isNull() | (F.col(name) < least)
    reason = first_reason(
        (F.col("missed") > rules.max_missed, "STALE"), (F.coalesce(F.col("exchange") != rules.exchange, F.lit(True)), "EXCHANGE"), (F.coalesce(~F.col("series").isin(*rules.series), F.lit(True)), "SERIES"), (below("price", rules.min_price), "PRICE"),
        (below("turnover_20", rules.min_turnover_20), "TURNOVER_20"), (below("turnover_50", rules.min_turnover_50), "TURNOVER_50"), (F.col("history") < rules.min_history, "HISTORY"), (F.col("asm") | F.col("gsm"), "SURVEILLANCE"),
        (F.col("series").isin(*TRADE_TO_TRADE), "TRADE_TO_TRADE"),
    )
    return found.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def survivorship(as_of: DataFrame, settled: DataFrame, collected: DataFrame, look_back: int = 365, delistings: bool = True) -> DataFrame:
    """(as_of, missing_days, status, reasons): what the evidence of a date proves about names that are gone.

    settled: (day) that have a settled price file; collected: (flag, day) on which a flag list was fetched. COMPLETE needs a file
    for each calendar day of the window and both lists fetched on the date itself. Without any file by then missing_days is null,
    and without delistings as well the status is BIASED. Windows run over days, one row each.
    """
    days = settled.where("day IS NOT NULL").select("day").distinct().select("day", F.lit(1).alias("n"), F.lit(None).cast("date").alias("as_of"))
    line = days.unionByName(as_of.select(F.col("as_of").alias("day"), F.lit(0).alias("n"), "as_of"))
    w = W.orderBy(F.unix_date("day"))
    line = line.select("as_of", F.sum("n").over(w.rangeBetween(-(look_back - 1), 0)).alias("have"), F.sum("n").over(w.rangeBetween(W.unboundedPreceding, 0)).alias("ever")).where("as_of IS NOT NULL")
    lists = collected.groupBy("flag").agg(F.min("day").alias("start"))
    for k in ("ASM", "GSM"):
        begun = lists.where(F.col("flag") == k).agg(F.min("start").alias(f"{k}_start"))
        there = collected.where(F.col("flag") == k).select(F.col("day").alias("as_of"), F.lit(True).alias(f"{k}_there")).distinct()
        line = line.crossJoin(F.broadcast(begun)).join(there, "as_of", "left")
    why = [F.when(F.col("ever") == 0, F.lit("no price files")).when(F.col("have") < look_back, F.concat(F.lit(look_back) - F.col("have"), F.lit(" days without a price file")))]
    for k in ("ASM", "GSM"):
        start = F.col(f"{k}_start")
        why.append(F.when(start.isNull(), F.lit(f"{k} never collected")).when(start > F.col("as_of"), F.concat(F.lit(f"{k} starts "), start.cast("string"))).when(F.col(f"{k}_there").isNull(), F.lit(f"{k} not collected")))
    line = line.select("as_of", F.when(F.col("ever") > 0, F.lit(look_back) - F.col("have")).alias("missing_days"), F.concat_ws("; ", *why).alias("reasons"))
    if not delistings:
        line = line.withColumn("reasons", F.when(F.col("missing_days").isNull(), F.lit("current listings only")).otherwise(F.col("reasons")))
    status = F.when(F.col("missing_days").isNull(), F.lit("PARTIAL" if delistings else "BIASED")).when(F.col("reasons") == "", "COMPLETE").otherwise("PARTIAL")
    return line.select("as_of", "missing_days", status.alias("status"), "reasons")
