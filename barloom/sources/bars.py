"""Daily bars and what goes with them, derived from the star-schema tables.

Bars carry (instrument, trade_date, open, high, low, close, volume), one row per instrument and day of trade.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price path per supplier: its days' mean discounts against the overall mean, cumulated as log returns."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("trade_date"), "l_discount", "l_tax", "l_quantity")
    mean = items.agg(F.round(F.avg("l_discount"), 6).alias("mu"))
    # Few items share a day, so they go to their supplier's task at once instead of meeting by day first.
    days = items.repartition("instrument").groupBy("instrument", "trade_date").agg(F.avg("l_discount").alias("dc"), F.avg("l_tax").alias("tx"), F.sum("l_quantity").alias("volume"))
    w = W.partitionBy("instrument").orderBy("trade_date")
    path = days.crossJoin(F.broadcast(mean)).withColumn("close", F.round(100 * F.exp(F.sum(0.5 * (F.col("dc") - F.col("mu"))).over(w)), 4))
    path = path.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return path.select(
        "instrument", "trade_date", "open",
        F.round(F.greatest("open", "close") * (1 + F.col("tx") / 10) + 3e-9, 4).alias("high"),
        F.round(F.least("open", "close") * (1 - F.col("tx") / 10) + 3e-9, 4).alias("low"),
        "close", "volume",
    )


def trade_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of trades: price is extended price by quantity; within a day trades are ordered by all their keys."""
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    trade = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return items.groupBy(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("trade_date")).agg(
        F.min_by(price, trade).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, trade).alias("close"), F.sum("l_quantity").alias("volume")
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, sector): a supplier's nation."""
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("instrument"), F.col("n_name").alias("sector"))


def sessions(bars: DataFrame) -> DataFrame:
    """(trade_date, session): the observed calendar, days numbered from 1. One row per day of trade, so one small window."""
    days = bars.select("trade_date").distinct()
    return days.select("trade_date", F.row_number().over(W.orderBy("trade_date")).alias("session"))


def known_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing bars by knowledge time: every line item is an observation of its supplier's day, known l_quantity days later.

    (instrument, trade_date, close, known_at), several rows per instrument and day: later ones revise earlier ones.
    """
    items = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    rows = items.select(F.col("l_suppkey").alias("instrument"), day.alias("trade_date"), F.round(F.col("l_extendedprice") / F.col("l_quantity") + 3e-9, 4).alias("close"), F.date_add(day, F.col("l_quantity").cast("int")).alias("known_at"))
    return rows.groupBy("instrument", "trade_date", "known_at").agg(F.max("close").alias("close"))


def actions(bars: DataFrame) -> DataFrame:
    """Splits by rule: every 180th bar of an instrument is an ex-date; 2:1 for even instruments, 3:2 for odd ones.

    (instrument, ex_date, num, den, factor): factor is what earlier prices are multiplied by.
    """
    n = F.row_number().over(W.partitionBy("instrument").orderBy("trade_date"))
    rows = bars.select("instrument", F.col("trade_date").alias("ex_date"), n.alias("n")).where(F.col("n") % 180 == 0)
    even = F.col("instrument") % 2 == 0
    rows = rows.select("instrument", "ex_date", F.when(even, 2).otherwise(3).alias("num"), F.when(even, 1).otherwise(2).alias("den"))
    return rows.withColumn("factor", F.col("den") / F.col("num"))
