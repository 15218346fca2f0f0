"""Queries of bars, features, strength, trend and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import r6
from barloom.operators import features, strength, trend
from barloom.plans import sql
from barloom.plans.sql import BARS, FEATURES, STAGE, STRENGTH, TREND, WEEKLY, with_
from barloom.sources.bars import actions, model_bars, sessions, trade_bars


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


FEATURE_NAMES = ["daily_return", "true_range", "atr_14", "atr_pct_14", *[f"sma_{n}" for n in (20, 50, 150, 200)], *[f"volume_avg_{n}" for n in (5, 10, 20, 50)], "volume_ratio_20", "volume_ratio_50", "volatility_20", "volatility_50"]
PLAIN = ["high_20", "high_50", "high_252", "low_20", "low_50", "low_252"]
RS = ["ret_63", "ret_126", "ret_189", "ret_252", "rs_raw", "rs_percentile"]


def flagship(spark, d):
    bars = model_bars(spark, d)
    return trend.trend_status(bars).where("status = 'PASS'").join(trend.weekly_stage(bars).select("instrument", "trade_date", "stage"), ["instrument", "trade_date"])


QUERIES = {
    "flagship_trend_screen": flagship,
    "src_model_bars": model_bars,
    "src_trade_bars": lambda s, d: rounded(trade_bars(s, d), "open", "high", "low", "close"),
    "dom20_daily_features": lambda s, d: rounded(features.daily_features(model_bars(s, d)), *FEATURE_NAMES),
    "agg01_weekly_bars": lambda s, d: features.weekly_bars(model_bars(s, d)),
    "dom22_relative_strength": lambda s, d: rounded(strength.relative_strength(model_bars(s, d)), *RS),
    "win08_percent_rank": lambda s, d: strength.relative_strength(model_bars(s, d)).where("rs_raw IS NOT NULL").select(
        "instrument", "trade_date", (1 + F.floor(98 * F.percent_rank().over(W.partitionBy("trade_date").orderBy("rs_raw")))).cast("int").alias("rs_rank")
    ),
    "win14_average_ranks": lambda s, d: model_bars(s, d).select("instrument", "trade_date", strength.average_rank(F.col("volume"), "trade_date").alias("volume_rank")),
    "fil03_trend_conditions": lambda s, d: rounded(trend.trend_conditions(model_bars(s, d)), "measurement", "threshold"),
    "fil04_trend_status": lambda s, d: trend.trend_status(model_bars(s, d)),
    "dom23_weekly_stage": lambda s, d: rounded(trend.weekly_stage(model_bars(s, d)), "sma_w", "slope_pct", "prior_pct"),
    "dom24_trend_scan": lambda s, d: flagship(s, d).groupBy("trade_date", "stage").agg(F.count("*").alias("n_pass"), F.max("rs_rank").alias("best_rank")),
    "dom30_swings": lambda s, d: features.swings(model_bars(s, d)),
    "win18_sessions": lambda s, d: sessions(model_bars(s, d)),
    "src_actions": lambda s, d: actions(model_bars(s, d)).withColumn("factor", F.round("factor", 6)),
}

ORACLES = {
    "flagship_trend_screen": with_(BARS, FEATURES, STRENGTH, TREND, WEEKLY, STAGE) + "SELECT instrument, trade_date, s.close, rs_rank, n_passed, status, stage FROM status s JOIN stage USING (instrument, trade_date) WHERE status = 'PASS'",
    "src_model_bars": with_(BARS) + "SELECT * FROM bars",
    "src_trade_bars": """SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS trade_date,
  round(arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) + 3e-10, 6) AS open, round(max(l_extendedprice / l_quantity) + 3e-10, 6) AS high,
  round(min(l_extendedprice / l_quantity) + 3e-10, 6) AS low, round(arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) + 3e-10, 6) AS close, sum(l_quantity) AS volume
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""",
    "dom20_daily_features": with_(BARS, FEATURES) + f"SELECT instrument, trade_date, open, high, low, close, volume, {', '.join(PLAIN)}, {sql.r6(*FEATURE_NAMES)} FROM feat",
    "agg01_weekly_bars": with_(BARS, WEEKLY) + "SELECT * FROM weekly",
    "dom22_relative_strength": with_(BARS, STRENGTH) + f"SELECT instrument, trade_date, {sql.r6(*RS)}, population, rs_rank, rs_status FROM strength",
    "win08_percent_rank": with_(BARS, STRENGTH) + "SELECT instrument, trade_date, CAST(1 + floor(98 * percent_rank() OVER (PARTITION BY trade_date ORDER BY rs_raw)) AS INTEGER) AS rs_rank FROM strength WHERE rs_raw IS NOT NULL",
    "win14_average_ranks": with_(BARS) + "SELECT instrument, trade_date, rank() OVER (PARTITION BY trade_date ORDER BY volume) + (count(*) OVER (PARTITION BY trade_date, volume) - 1) / 2.0 AS volume_rank FROM bars",
    "fil03_trend_conditions": with_(BARS, FEATURES, STRENGTH, TREND) + f"SELECT instrument, trade_date, condition_id, name, passed, {sql.r6('measurement', 'threshold')} FROM cond",
    "fil04_trend_status": with_(BARS, FEATURES, STRENGTH, TREND) + "SELECT * FROM status",
    "dom23_weekly_stage": with_(BARS, WEEKLY, STAGE) + f"SELECT instrument, trade_date, stage, is_partial, {sql.r6('sma_w', 'slope_pct', 'prior_pct')} FROM stage",
    "dom24_trend_scan": with_(BARS, FEATURES, STRENGTH, TREND, WEEKLY, STAGE) + "SELECT trade_date, stage, count(*) AS n_pass, max(rs_rank) AS best_rank FROM status JOIN stage USING (instrument, trade_date) WHERE status = 'PASS' GROUP BY 1, 2",
    "dom30_swings": with_(BARS) + """, n AS (SELECT *, lead(trade_date, 5) OVER w AS confirmed_on, row_number() OVER w AS n, max(high) OVER c AS top, min(low) OVER c AS bottom FROM bars
  WINDOW w AS (PARTITION BY instrument ORDER BY trade_date), c AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT instrument, trade_date, confirmed_on, 'HIGH' AS kind, high AS price FROM n WHERE confirmed_on IS NOT NULL AND n > 5 AND high = top
UNION ALL SELECT instrument, trade_date, confirmed_on, 'LOW', low FROM n WHERE confirmed_on IS NOT NULL AND n > 5 AND low = bottom""",
    "win18_sessions": with_(BARS) + "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session FROM (SELECT DISTINCT trade_date FROM bars)",
    "src_actions": with_(BARS) + """SELECT instrument, trade_date AS ex_date, CASE WHEN instrument % 2 = 0 THEN 2 ELSE 3 END AS num, CASE WHEN instrument % 2 = 0 THEN 1 ELSE 2 END AS den,
  round(CASE WHEN instrument % 2 = 0 THEN 0.5 ELSE 2.0 / 3.0 END, 6) AS factor FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY trade_date) AS n FROM bars) WHERE n % 180 = 0""",
}
