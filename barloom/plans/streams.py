"""Queries that run a stream over all ticks there are and return what it wrote."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom import streaming as st
from barloom.functions import r6
from barloom.operators import health, incremental, tracking
from barloom.plans import market as market_plans
from barloom.plans.detections import DETECTIONS
from barloom.plans.screen import rounded
from barloom.plans.sql import BARS, with_
from barloom.sources import store
from barloom.sources.bars import model_bars, sectors, sessions, table
from barloom.streaming import daily


def ticks(s, d):
    return st.tick_stream(s, f"{d}/events.parquet")


def candles(s, d):
    at = st.scratch(s)
    out = st.candles(ticks(s, d), late="0 seconds")
    st.run_available(out, f"{at}/out", f"{at}/state", "complete")
    return st.latest_batch(s, f"{at}/out", out.schema)


def freshness(s, d):
    at = st.scratch(s)
    out = st.freshness(ticks(s, d))
    st.run_available(out, f"{at}/out", f"{at}/state", "complete")
    return st.latest_batch(s, f"{at}/out", out.schema)


def alerts(s, d):
    at = st.scratch(s)
    levels = table(s, d, "events").groupBy(F.col("user_id").alias("symbol")).agg(r6(F.avg("value")).alias("level"))
    return st.run_available(st.alerts(ticks(s, d), levels), f"{at}/out", f"{at}/state")


def tracked(s, d):
    return rounded(tracking.track_breakouts(tracking.daily_detections(model_bars(s, d))), "event_pivot", "event_ratio")


def replayed(s, d, parts: int = 4):
    """Detections of all sessions as they come, a part of the sessions at a time; each part is a run of its own from the checkpoint of the last."""
    at, bars = st.scratch(s), model_bars(s, d)
    days = sessions(bars).select("trade_date", F.ntile(parts).over(W.orderBy("session")).alias("part"))
    tracking.daily_detections(bars).join(F.broadcast(days), "trade_date").write.partitionBy("part").parquet(f"{at}/all")
    out = None
    for k in range(1, parts + 1):
        s.read.parquet(f"{at}/all/part={k}").select(*s.createDataFrame([], tracking.DETECTION).columns).write.mode("append").parquet(f"{at}/come")
        out = st.run_available(daily.track_stream(daily.detection_stream(s, f"{at}/come")), f"{at}/out", f"{at}/state")
    return rounded(out, "event_pivot", "event_ratio")


CUT_DAYS = ("1996-06-30", "1997-03-31")


def landed(s, d):
    """The folder that bars land in, after each of three parts has: up to each of CUT_DAYS, and the rest."""
    at = st.scratch(s)
    part = sum((F.col("trade_date") > F.lit(day).cast("date")).cast("int") for day in CUT_DAYS)
    # Bars are worked out once for all landings.
    model_bars(s, d).withColumn("part", part).write.partitionBy("part").parquet(f"{at}/come")
    for k in range(len(CUT_DAYS) + 1):
        incremental.land(s.read.parquet(f"{at}/come").where(F.col("part") == k).drop("part"), f"{at}/bars")
        yield at


def grown(s, d):
    """The days' tables after a run over each part of the bars that landed."""
    for at in landed(s, d):
        incremental.update_days(s, f"{at}/bars", f"{at}/days", sectors(s, d), market_plans.with_indices)
    return at


def new_days(s, d):
    rows = incremental.stored_readings(s, f"{grown(s, d)}/days", min_universe=10, min_judged=3)
    return rounded(health.thrust_days(rows), *market_plans.READ)


def caught_up(s, d):
    """Sessions that each of three runs of a stream over the bars' folder finds to scan, which lands in three parts."""
    for at in landed(s, d):
        daily.catch_up(s, f"{at}/bars", f"{at}/scans", f"{at}/state")
    return s.read.parquet(f"{at}/scans").select("trade_date", F.col("run").cast("int").alias("run"))


def landings(bars):
    """Bars as they land three times: early ones of a feed, a third of them one too high; the exchange's, but for each fifth instrument; the feed's once more."""
    off = F.when(F.col("instrument") % 3 == 0, 1.0).otherwise(0.0)
    feed = bars.withColumns({"close": F.col("close") + off, "high": F.col("high") + off, "provider": F.lit("FEED"), "status": F.lit("PROVISIONAL")})
    final = bars.where("instrument % 5 <> 0").withColumns({"provider": F.lit(store.FINAL), "status": F.lit("OK")})
    again = bars.withColumns({"provider": F.lit("FEED"), "status": F.lit("PROVISIONAL")})
    return [rows.withColumn("order", F.lit(k).cast("long")) for k, rows in enumerate((feed, final, again))]


def final_over_provisional(s, d):
    """All versions of the bars after each landing was a run of the merge stream; the last batch is merged a second time, as after a lost run."""
    at = st.scratch(s)
    # Landings are read up to three times each; their bars are worked out once.
    with store.released(s):
        model_bars(s, d).select("instrument", "trade_date", *store.PRICES).write.option("compression", "zstd").parquet(f"{at}/model")
    for k, rows in enumerate(landings(s.read.parquet(f"{at}/model"))):
        rows.write.mode("append").option("compression", "zstd").parquet(f"{at}/come")
        store.merge_stream(s.readStream.schema(rows.schema).parquet(f"{at}/come"), f"{at}/bars", f"{at}/state")
    store.merge_batch(s, f"{at}/bars", rows, k)
    return s.read.parquet(f"{at}/bars").select("instrument", "trade_date", "close", "provider", "status", "batch_from", "batch_to")


def adjusted_rewrite(s, d):
    """Adjusted bars saved twice: all of them, then those of even instruments at half the price, without their odd days, and as another version too."""
    at = st.scratch(s)
    rows = model_bars(s, d).select("instrument", "trade_date", "close", F.lit("v1").alias("version"), F.lit(None).cast("string").alias("snapshot"), F.lit(1).alias("computed_at"))
    even = rows.where("instrument % 2 = 0 AND day(trade_date) % 2 = 0").withColumns({"close": F.col("close") / 2, "computed_at": F.lit(2)})
    store.rewrite_adjusted(s, f"{at}/adjusted", rows)
    store.rewrite_adjusted(s, f"{at}/adjusted", even.unionByName(even.withColumn("version", F.lit("v2"))))
    return s.read.parquet(f"{at}/adjusted").select("instrument", "trade_date", "version", "snapshot", r6(F.col("close")).alias("close"))


QUERIES = {"str04_final_over_provisional": final_over_provisional, "bt12_adjusted_rewrite": adjusted_rewrite, "dom75_new_days": new_days, "str06_catch_up": caught_up, "str01_candles": candles, "str02_freshness": freshness, "str03_alerts": alerts, "dom39_tracked_breakouts": tracked, "str05_replayed_breakouts": replayed}

#: Detections of each bar, and the events and states that follow from them.
TRACKED = with_(BARS, DETECTIONS) + """, src AS (SELECT *, CASE WHEN state = 'BREAKOUT' THEN 'STRUCTURAL' WHEN last_base = base_start AND close > last_pivot AND ratio >= 1.5 THEN 'PRIOR_DAY_PIVOT' END AS source FROM dt WHERE state <> 'INVALIDATED'),
-- a base's first day with a source is its event
ev AS (SELECT instrument, base_start, trade_date AS breakout_date, source, CASE source WHEN 'STRUCTURAL' THEN level ELSE last_pivot END AS event_pivot, ratio AS event_ratio FROM src WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument, base_start ORDER BY trade_date) = 1)
SELECT s.instrument, s.trade_date, s.base_start, CASE WHEN e.base_start IS NULL OR (e.breakout_date = s.trade_date AND e.source = 'STRUCTURAL') THEN state WHEN close >= event_pivot THEN 'BREAKOUT' ELSE 'FAILED' END AS status,
  CASE WHEN e.base_start IS NOT NULL THEN 'bo-' || substr(sha256(s.instrument || '|' || s.base_start || '|default'), 1, 20) END AS event_id, coalesce(e.breakout_date = s.trade_date, false) AS is_new, e.source, e.breakout_date,
  round(event_pivot + 3e-10, 6) AS event_pivot, round(event_ratio + 3e-10, 6) AS event_ratio
FROM src s LEFT JOIN ev e ON e.instrument = s.instrument AND e.base_start = s.base_start AND e.breakout_date <= s.trade_date"""

ORACLES = {
    "str04_final_over_provisional": with_(BARS) + """, v AS (SELECT instrument, trade_date, CASE WHEN instrument % 3 = 0 THEN close + 1.0 ELSE close END AS early, close FROM bars)
SELECT instrument, trade_date, early AS close, 'FEED' AS provider, 'PROVISIONAL' AS status, CAST(0 AS BIGINT) AS batch_from, CAST(CASE WHEN instrument % 5 <> 0 THEN 1 WHEN instrument % 3 = 0 THEN 2 END AS BIGINT) AS batch_to FROM v
UNION ALL SELECT instrument, trade_date, close, 'EXCHANGE', 'OK', 1, NULL FROM v WHERE instrument % 5 <> 0
UNION ALL SELECT instrument, trade_date, close, 'FEED', 'PROVISIONAL', 2, NULL FROM v WHERE instrument % 5 = 0 AND instrument % 3 = 0""",
    "bt12_adjusted_rewrite": with_(BARS) + """SELECT instrument, trade_date, 'v1' AS version, 'LIVE' AS snapshot, round(CASE WHEN instrument % 2 = 0 THEN close / 2 ELSE close END + 3e-10, 6) AS close FROM bars WHERE instrument % 2 = 1 OR day(trade_date) % 2 = 0
UNION ALL SELECT instrument, trade_date, 'v2', 'LIVE', round(close / 2 + 3e-10, 6) FROM bars WHERE instrument % 2 = 0 AND day(trade_date) % 2 = 0""",
    "dom75_new_days": market_plans.ORACLES["dom73_readings"],
    # The first run scans the latest session there is, the others all behind the last one scanned.
    "str06_catch_up": with_(BARS) + """SELECT DISTINCT trade_date, CAST(CASE WHEN trade_date <= DATE '1996-06-30' THEN 0 WHEN trade_date <= DATE '1997-03-31' THEN 1 ELSE 2 END AS INTEGER) AS run FROM bars
WHERE trade_date >= (SELECT max(trade_date) FROM bars WHERE trade_date <= DATE '1996-06-30')""",
    "dom39_tracked_breakouts": TRACKED,
    "str05_replayed_breakouts": TRACKED,
    "str01_candles": "SELECT user_id AS symbol, date_trunc('hour', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    "str02_freshness": "SELECT user_id AS symbol, max(ts) AS last_at, arg_max(value, (ts, event_id)) AS last_price FROM events GROUP BY 1",
    "str03_alerts": """WITH l AS (SELECT user_id AS symbol, round(avg(value) + 3e-10, 6) AS level FROM events GROUP BY 1)
SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS day, CASE WHEN value >= level THEN 'CROSSED' ELSE 'APPROACHING' END AS kind FROM events JOIN l ON symbol = user_id WHERE value >= level * (1 - 2.0 / 100)""",
}
