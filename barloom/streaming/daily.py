"""Daily state as streams: breakouts tracked with keyed state, final bars over provisional ones, sessions caught up.

Each run takes what has come since the last one (AvailableNow) and goes on from its checkpoint, so a lost or stopped run
loses nothing and repeats nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators import incremental
from barloom.operators.tracking import DETECTION, TRACKED

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PRIOR = "trade_date date, base_start date, pivot double, pivot_date date"
SEEN = ("trade_date", "base_start", "level", "pivot", "pivot_date", "close", "ratio", "state")
EVENT = "source string, breakout_date date, pivot double, ratio double"


class BreakoutTracker(StatefulProcessor):
    """Per instrument: the last detection seen, and the event of each base. A run looks up once the event of each base that an earlier run may have seen."""

    def __init__(self, config: str, volume_ratio: float):
        self.config, self.volume_ratio = config, volume_ratio

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prior = handle.getValueState("prior", PRIOR)
        self.events = handle.getMapState("events", "base_start date", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        instrument, prior = int(key[0]), self.prior.get()
        upto = None if prior is None else prior[0]
        days = sorted((d for part in rows for d in zip(*(part[c].tolist() for c in SEEN), strict=True)), key=lambda d: d[0])
        seen, out = {}, []
        for at, base, level, pivot, pivot_day, close, ratio, state in days:
            if prior is not None and at <= prior[0]:
                continue
            if state != "INVALIDATED":
                if base not in seen:
                    # A base that starts behind the last run's day was not there to have an event.
                    event = None if upto is None or base > upto else self.events.getValue((base,))
                    seen[base] = None if event is None else (self.name(instrument, base), *event)
                event = seen[base]
                new = event is None
                if new:
                    if state == "BREAKOUT" and level == level:
                        event = ("STRUCTURAL", at, level, none(ratio))
                    elif prior is not None and prior[1] == base and prior[2] is not None and prior[3] is not None and close > prior[2] and ratio >= self.volume_ratio:
                        event = ("PRIOR_DAY_PIVOT", at, prior[2], none(ratio))
                    if event is not None:
                        self.events.updateValue((base,), event)
                        event = seen[base] = (self.name(instrument, base), *event)
                if event is None or (new and event[1] == "STRUCTURAL"):
                    status = state
                else:
                    status = "BREAKOUT" if close >= event[3] else "FAILED"
                name, *rest = event or (None,) * 5
                out.append((instrument, at, base, status, name, new and event is not None, *rest))
            prior = (at, base, none(pivot), pivot_day)
        if prior is not None:
            self.prior.update(prior)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACKED.split(", ")])

    def name(self, instrument: int, base) -> str:
        return "bo-" + hashlib.sha256(f"{instrument}|{base.isoformat()}|{self.config}".encode()).hexdigest()[:20]

    def close(self) -> None:
        pass


def none(x) -> float | None:
    """A number of pandas, or None."""
    return None if pd.isna(x) else float(x)


def track_stream(detections: DataFrame, config: str = "default", volume_ratio: float = 1.5) -> DataFrame:
    """TRACKED rows of a stream of DETECTION, as operators.tracking.track_breakouts has them in one go.

    Days have to come in order, some or many at a time; a day not behind an instrument's last one is passed over, so a repeated
    file changes nothing. A base starts on its detections' days at the latest. State grows by one event a base.
    """
    detections.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return detections.groupBy("instrument").transformWithStateInPandas(BreakoutTracker(config, volume_ratio), TRACKED, outputMode="Append", timeMode="None")


def detection_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(DETECTION).parquet(folder)


def catch_up(spark: SparkSession, bars: str, scans: str, checkpoint: str) -> None:
    """Scans the sessions of a folder of bars that have come since the last scan, once each; scans gets (trade_date, run).

    A batch is one run. Its rows go to a partition of its own, which a repeated batch overwrites with the same, as it looks
    only at the scans of earlier runs.
    """
    schema = spark.read.parquet(bars).schema
    stream = spark.readStream.schema(schema).parquet(bars).select("trade_date")

    def scan(batch: DataFrame, run: int) -> None:
        done = spark.read.parquet(scans).where(F.col("run") < run) if run else batch.limit(0)
        incremental.sessions_to_scan(batch, done).write.mode("overwrite").parquet(f"{scans}/run={run}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(scan).start().awaitTermination()
