"""Market days kept as tables, of which a run rewrites the months that new sessions touch and reads no more bars than these need.

Tables are partitioned by month. A bar's features reach back over its own instrument's bars, not over the calendar, so how far a
run must read is found from counts of bars by instrument and month: the latest month from which on every instrument has enough
bars before the months in question. What follows the panel has one row a day, or a sector and day, and is small.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import health, market

#: Bars before a bar that its features, its relative strength and the slope of its averages read.
FEATURE_BARS = 253
#: Bars before a bar whose later columns or earlier leaders a new bar changes or reads.
NEAR_BARS = 21
BREAKOUTS = "instrument long, trade_date date, level double, held boolean, success boolean, failed boolean, ret_5 double, ret_judged double"


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def replace_months(rows: DataFrame, path: str) -> None:
    """Writes rows by month and leaves months without rows as they are. A run that is repeated writes the same."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def land(bars: DataFrame, path: str) -> None:
    """Adds bars to a table by month. A month's bars come together first, or each task would write a file of each month."""
    bars.withColumn("month", month_of(F.col("trade_date"))).hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def reach(months: DataFrame, since: str, bars: int) -> str:
    """The month to read from, so that each instrument with bars in `since` or later has `bars` bars before it, or all it has.

    months: (instrument, month, n). No instrument's bars are looked at, only how many it has in a month.
    """
    active = months.where(F.col("month") >= since).select("instrument").distinct()
    back = W.partitionBy("instrument").orderBy(F.desc("month"))
    before = months.where(F.col("month") < since).join(active, "instrument").withColumn("upto", F.sum("n").over(back))
    each = before.groupBy("instrument").agg(F.coalesce(F.max(F.when(F.col("upto") >= bars, F.col("month"))), F.min("month")).alias("month"))
    return each.agg(F.min("month")).first()[0] or since


def sessions_to_scan(sessions: DataFrame, scans: DataFrame) -> DataFrame:
    """(trade_date): sessions after the last scan of scans(trade_date); without any scan only the latest session. Nulls are none."""
    last = scans.agg(F.max("trade_date").alias("last"))
    newest = sessions.agg(F.max("trade_date").alias("newest"))
    rows = sessions.select("trade_date").distinct().crossJoin(F.broadcast(last)).crossJoin(F.broadcast(newest))
    return rows.where((F.col("trade_date") > F.col("last")) | (F.col("last").isNull() & (F.col("trade_date") == F.col("newest")))).select("trade_date")


def update_days(spark: SparkSession, bars_path: str, root: str, sectors: DataFrame, mark=lambda panel: panel) -> str | None:
    """Brings the tables under root up to the bars that have landed: panel, counts, sectors and breakouts. Returns the first month that was rewritten, None if no session was new.

    mark adds columns to the panel (those of further indices). Bars may be added to the newest months or behind them; bars of
    stored sessions are taken for unchanged.
    """
    bars = spark.read.parquet(bars_path).withColumn("month", F.col("month").cast("string"))
    stored = spark.read.parquet(f"{root}/counts").select("trade_date") if there(spark, f"{root}/counts") else bars.select("trade_date").limit(0)
    new = bars.select("trade_date", "month").distinct().join(stored, "trade_date", "left_anti")
    since = new.agg(F.min("month")).first()[0]
    if since is None:
        return None
    months = bars.groupBy("instrument", "month").agg(F.count("*").alias("n"))
    near = reach(months, since, NEAR_BARS)
    far = reach(months, near, FEATURE_BARS)
    panel = market.panel(bars.where(F.col("month") >= far).drop("month"), since=date.fromisoformat(f"{near}-01"))
    replace_months(mark(panel.select(*health.PANEL)).withColumn("month", month_of(F.col("trade_date"))), f"{root}/panel")
    kept = spark.read.parquet(f"{root}/panel").withColumn("month", F.col("month").cast("string")).where(F.col("month") >= near)
    fresh = lambda rows, first: rows.withColumn("month", month_of(F.col("trade_date"))).where(F.col("month") >= first)
    replace_months(fresh(health.sector_days(kept.where(F.col("month") >= since), sectors), since), f"{root}/sectors")
    replace_months(fresh(market.breakouts(kept), near), f"{root}/breakouts")
    # Last, as these are what says that a session is stored.
    replace_months(fresh(health.day_counts(kept), since), f"{root}/counts")
    return since


def stored_readings(spark: SparkSession, root: str, **least: int) -> DataFrame:
    """health.readings() of the tables under root."""
    table = lambda name: spark.read.parquet(f"{root}/{name}").drop("month")
    counts = table("counts")
    # There may be no breakout at all.
    judged = health.judged_breakouts(spark.read.schema(BREAKOUTS).parquet(f"{root}/breakouts"), counts.select("trade_date"))
    return health.readings(counts, health.sectors_up(table("sectors")), judged, **least)
