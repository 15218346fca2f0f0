"""Tables of bars that are merged in place: versions of landed bars by batch, and adjusted bars that are rewritten and pruned.

Only the partitions that a batch touches are read and replaced. A merge is a function of what stood before the batch and of the
batch, and each row says which batch made it, so a batch that is run again, in whole or after it broke off between two
partitions, ends in the same table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.incremental import month_of, there

KEY = ["instrument", "trade_date"]
PRICES = ["open", "high", "low", "close", "volume"]
#: The provider whose bars are final.
FINAL = "EXCHANGE"
BUCKETS = 64
#: Bars of a month that a merge leaves to one task; larger months are dealt out by instrument.
MONTH_BARS = 500_000
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Steps inside drop their shuffle files when they end, not when the driver happens to collect its garbage; so they are for what is written and read again."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def merged_versions(stored: DataFrame, come: DataFrame, batch: int, shares: int = 1) -> DataFrame:
    """Versions(instrument, trade_date, prices, provider, status, batch_from, batch_to) after a batch of bars(same, and order).

    stored is first taken back to before the batch. In the order of `order` a bar replaces the current one of its day, unless it says the
    same, or the current one is final and it is not. batch_to is the batch that replaced a version, null while it stands; of
    several of one batch all but the last are versions that it closed itself. Bars with a null key, or with prices that are
    no bar, are left out. Versions that stood closed before the batch stay where they are read; the others meet once, by month and one of `shares` of its instruments.
    """
    before = stored.where(F.col("batch_from") < batch).withColumn("batch_to", F.when(F.col("batch_to") < batch, F.col("batch_to")))
    closed = before.where("batch_to IS NOT NULL")
    bar = F.col("low").isNotNull() & (F.col("low") > 0) & (F.least("open", "close") >= F.col("low")) & (F.greatest("open", "close") <= F.col("high")) & (F.col("volume") >= 0)
    good = come.dropna(subset=KEY).where(bar)
    rows = before.where("batch_to IS NULL").withColumn("order", F.lit(None).cast("long")).unionByName(good.withColumns({"batch_from": F.lit(batch).cast("long"), "batch_to": F.lit(None).cast("long")}))
    cell = [F.trunc("trade_date", "month"), F.pmod(F.xxhash64("instrument"), F.lit(shares))]
    rows = rows.repartition(*cell)
    w = W.partitionBy(*cell, *KEY).orderBy(F.asc_nulls_first("order"), "provider", *PRICES)
    settled = F.coalesce(F.max(F.col("provider") == FINAL).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    rows = rows.where("provider IS NOT NULL").withColumn("late", settled & (F.col("provider") != FINAL)).where("NOT late").drop("late")
    says = F.struct(*PRICES, "provider")
    rows = rows.withColumn("again", F.coalesce(F.lag(says).over(w).eqNullSafe(says), F.lit(False)) & F.col("order").isNotNull()).where("NOT again").drop("again")
    replaced = F.lead("batch_from").over(w)
    return closed.unionByName(rows.withColumn("batch_to", replaced).drop("order"))


def merge_batch(spark: SparkSession, path: str, come: DataFrame, batch: int) -> None:
    """merged_versions() of the months that a batch touches, written over them. The months' new files are all written before any old one goes."""
    month = month_of(F.col("trade_date"))
    with released(spark):
        months = {r.month: r.n for r in come.where("trade_date IS NOT NULL").groupBy(month.alias("month")).agg(F.count("*").alias("n")).collect()}
        if not months:
            return
        schema = come.drop("order").withColumns({"batch_from": F.lit(0).cast("long"), "batch_to": F.lit(0).cast("long"), "month": month}).schema
        stored = spark.read.schema(schema).parquet(path) if there(spark, path) else spark.createDataFrame([], schema)
        stored = stored.where(F.col("month").isin(list(months))).drop("month")
        rows = merged_versions(stored, come, batch, 1 + max(months.values()) // MONTH_BARS).withColumn("month", month)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("month").parquet(path)


def merge_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Merges all that has come in a stream of bars since the last run, a micro-batch at a time."""
    spark = stream.sparkSession
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, batch: merge_batch(spark, path, rows, batch)).start().awaitTermination()


def rewrite_adjusted(spark: SparkSession, path: str, rows: DataFrame, prune: bool = True) -> None:
    """Saves adjusted bars(instrument, trade_date, version, snapshot, ...); of repeated keys the one with the latest computed_at stands.

    A null snapshot is LIVE. A key that is there is replaced, other versions and snapshots stay as they are. With prune, days of a saved
    (instrument, version, snapshot) that rows lacks vanish. Rows lie in buckets of instruments, of which only those in rows
    are read and written; empty rows change nothing.
    """
    of = ["instrument", "version", "snapshot"]
    rows = rows.withColumn("snapshot", F.coalesce("snapshot", F.lit("LIVE"))).withColumn("bucket", F.pmod(F.xxhash64("instrument"), F.lit(BUCKETS)).cast("int"))
    latest = W.partitionBy(*of, "trade_date").orderBy(F.desc("computed_at"), *sorted(c for c in rows.columns if c not in (*of, "trade_date", "computed_at")))
    rows = rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
    if touched and there(spark, path):
        stored = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched))
        gone = rows.select(*(of if prune else [*of, "trade_date"])).distinct()
        rows = rows.unionByName(stored.join(gone, gone.columns, "left_anti"))
    if touched:
        aside = f"{path}-aside"
        rows.write.mode("overwrite").parquet(aside)
        spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
