"""Structured Streaming jobs over ticks and bars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Ticks of a Parquet folder or file as a stream: (symbol, ts, price, event_id)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    return rows.select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id", "event_type")


def candles(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling OHLC of each symbol; ticks later than the watermark are left out. Ties of a time go by event."""
    at = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n")
    ).select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def freshness(ticks: DataFrame) -> DataFrame:
    """Last tick of each symbol, to be held against a clock."""
    return ticks.groupBy("symbol").agg(F.max("ts").alias("last_at"), F.max_by("price", F.struct("ts", "event_id")).alias("last_price"))


def alerts(ticks: DataFrame, levels: DataFrame, near_pct: float = 2.0, late: str = "1 day") -> DataFrame:
    """CROSSED and APPROACHING alerts of ticks against a static table of levels(symbol, level), once per symbol, kind and day."""
    rows = ticks.join(levels, "symbol")
    kind = F.when(F.col("price") >= F.col("level"), "CROSSED").when(F.col("price") >= F.col("level") * (1 - near_pct / 100), "APPROACHING")
    rows = rows.select("symbol", F.to_date("ts").alias("day"), kind.alias("kind"), "ts").where("kind IS NOT NULL")
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "day", "kind"]).select("symbol", "day", "kind")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and stops; rows as they were written. A later call goes on where this one ended."""
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/barloom"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def latest_batch(spark: SparkSession, out: str, schema) -> DataFrame:
    """The last complete result that run_available wrote in complete or update mode."""
    rows = spark.read.parquet(out)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("last"))), F.col("batch") == F.col("last")).select(*schema.names)
