"""Queries of the universe: candidates, snapshots, counts and survivorship of every month-end; factor sets and long uptrends."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import r6
from barloom.operators import adjust, labels, market, universe
from barloom.plans.market import ALL, SCORED, pan, scored
from barloom.plans.screen import rounded
from barloom.plans.sql import BARS, STRENGTH, with_
from barloom.plans.temporal import ACTIONS
from barloom.sources.bars import actions, model_bars, table

RULES = universe.UniverseRules(min_turnover_20=1000.0, min_turnover_50=1000.0)


def listed(s, d):
    """Model bars with the series of the day (every 17th day of the year trade to trade) and an exchange per instrument."""
    b = model_bars(s, d)
    series = F.when((F.dayofyear("trade_date") + F.col("instrument")) % 17 == 0, "BE").otherwise("EQ")
    return b.withColumn("series", series).withColumn("exchange", F.when(F.col("instrument") % 23 == 22, "BSE").otherwise("NSE"))


def flags(bars):
    """Surveillance from each ex-date of every third (ASM) and fifth (GSM) instrument on: 90 days long, known 3 days later."""
    a = actions(bars).select("instrument", F.col("ex_date").alias("valid_from"), F.date_add("ex_date", 90).alias("valid_to"), F.date_add("ex_date", 3).alias("known_from"))
    return a.where("instrument % 3 = 0").withColumn("flag", F.lit("ASM")).unionByName(a.where("instrument % 5 = 0").withColumn("flag", F.lit("GSM")))


def snapshot(s, d):
    b = listed(s, d)
    return universe.snapshot(universe.flagged(universe.candidates(b), flags(b)), RULES)


def survivorship(s, d):
    """Days of orders as days with a price file, but for each 13th before 1995; lists fetched from 1994 (ASM, not each fourth month) and 1995 (GSM)."""
    days = table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    settled = days.where("NOT (day(day) = 13 AND year(day) < 1995)")
    asm = days.where("year(day) >= 1994 AND month(day) % 4 <> 0").select(F.lit("ASM").alias("flag"), "day")
    gsm = days.where("year(day) >= 1995").select(F.lit("GSM").alias("flag"), "day")
    calendar = days.select(F.col("day").alias("trade_date"), F.lit(1).alias("session"))
    return universe.survivorship(universe.month_ends(calendar).select("as_of"), settled, asm.unionByName(gsm))


def factor_sets(s, d):
    """The factors known at the middle of 1997 against those at the end of 1998, with the ratios of some instruments corrected."""
    a = actions(model_bars(s, d)).select("instrument", "ex_date", "num", "den")
    fixed = F.when(F.col("instrument") % 10 == 4, F.col("num") + 1).otherwise(F.col("num"))
    return adjust.replace_sets(a.where("ex_date <= DATE '1997-06-30' AND instrument % 10 <> 3"), a.where("ex_date <= DATE '1998-12-31' AND instrument % 10 <> 6 AND (instrument % 2 = 0 OR ex_date <= DATE '1997-06-30')").withColumn("num", fixed))


def uptrend(s, d):
    days = market.regimes(market.breadth(pan(s, d)), min_members=10)
    return market.long_uptrend(days)


QUERIES = {
    "agg09_candidates": lambda s, d: rounded(universe.candidates(listed(s, d)), "turnover_20", "turnover_50"),
    "dom21_universe": lambda s, d: snapshot(s, d).select("instrument", "as_of", "price", "history", "missed", "asm", "gsm", "eligible", "reason"),
    "dom21_counts": lambda s, d: snapshot(s, d).groupBy("as_of").agg(F.count("*").alias("candidates"), F.count_if("eligible").alias("members"), F.count("reason").alias("excluded")),
    "fil06_survivorship": survivorship,
    "bt11_factor_sets": factor_sets,
    "dom67_long_uptrend": uptrend,
    "agg16_ic_summary": lambda s, d: labels.ic_summary(labels.information_coefficient(scored(s, d), "rs_raw", "outcome", "trade_date")).select("dates", r6(F.col("mean_ic")).alias("mean_ic"), r6(F.col("t_stat")).alias("t_stat")),
}

FOUND = """
lst AS (SELECT *, CASE WHEN (dayofyear(trade_date) + instrument) % 17 = 0 THEN 'BE' ELSE 'EQ' END AS series, CASE WHEN instrument % 23 = 22 THEN 'BSE' ELSE 'NSE' END AS exchange FROM bars),
me AS (SELECT last_day(CAST(m AS DATE)) AS as_of FROM (SELECT unnest(generate_series(date_trunc('month', min(trade_date)), date_trunc('month', max(trade_date)), INTERVAL 1 MONTH)) AS m FROM bars)),
up AS (SELECT as_of, l.*, row_number() OVER (PARTITION BY as_of, instrument ORDER BY trade_date DESC) AS rn FROM me JOIN lst l ON l.trade_date <= as_of),
cd AS (SELECT instrument, as_of, max(trade_date) AS last_trade, max(close) FILTER (WHERE rn = 1) AS price, max(series) FILTER (WHERE rn = 1) AS series, max(exchange) FILTER (WHERE rn = 1) AS exchange, avg(close * volume) FILTER (WHERE rn <= 20) AS turnover_20,
  avg(close * volume) FILTER (WHERE rn <= 50) AS turnover_50, CAST(max(rn) AS INTEGER) AS history FROM up GROUP BY 1, 2),
dy AS (SELECT DISTINCT trade_date AS day FROM bars),
found AS (SELECT cd.*, CAST((SELECT count(*) FROM dy WHERE day > last_trade AND day <= as_of) AS INTEGER) AS missed FROM cd)
"""
SNAP = """
fl AS (SELECT instrument, 'ASM' AS flag, ex_date FROM act WHERE instrument % 3 = 0 UNION ALL SELECT instrument, 'GSM', ex_date FROM act WHERE instrument % 5 = 0),
fs AS (SELECT f.instrument, as_of, bool_or(flag = 'ASM') AS asm, bool_or(flag = 'GSM') AS gsm FROM found f JOIN fl ON fl.instrument = f.instrument AND as_of BETWEEN ex_date + 3 AND ex_date + 90 GROUP BY 1, 2),
snap AS (SELECT f.instrument, f.as_of, price, history, missed, coalesce(asm, false) AS asm, coalesce(gsm, false) AS gsm, CASE WHEN missed > 5 THEN 'STALE' WHEN exchange <> 'NSE' THEN 'EXCHANGE' WHEN series <> 'EQ' THEN 'SERIES' WHEN price < 20 THEN 'PRICE'
  WHEN turnover_20 < 1000 THEN 'TURNOVER_20' WHEN turnover_50 < 1000 THEN 'TURNOVER_50' WHEN history < 253 THEN 'HISTORY' WHEN asm OR gsm THEN 'SURVEILLANCE' END AS reason FROM found f LEFT JOIN fs USING (instrument, as_of))
"""

ORACLES = {
    "agg09_candidates": with_(BARS, FOUND) + "SELECT * REPLACE (round(turnover_20 + 3e-10, 6) AS turnover_20, round(turnover_50 + 3e-10, 6) AS turnover_50) FROM found",
    "dom21_universe": with_(BARS, ACTIONS, FOUND, SNAP) + "SELECT *, reason IS NULL AS eligible FROM snap",
    "dom21_counts": with_(BARS, ACTIONS, FOUND, SNAP) + "SELECT as_of, count(*) AS candidates, count(*) - count(reason) AS members, count(reason) AS excluded FROM snap GROUP BY 1",
    "fil06_survivorship": """WITH dy AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
me AS (SELECT last_day(CAST(m AS DATE)) AS as_of FROM (SELECT unnest(generate_series(date_trunc('month', min(day)), date_trunc('month', max(day)), INTERVAL 1 MONTH)) AS m FROM dy)),
st AS (SELECT day FROM dy WHERE NOT (day(day) = 13 AND year(day) < 1995)), asm AS (SELECT day FROM dy WHERE year(day) >= 1994 AND month(day) % 4 <> 0), gsm AS (SELECT day FROM dy WHERE year(day) >= 1995),
e AS (SELECT as_of, (SELECT count(*) FROM st WHERE day <= as_of) AS ever, 365 - (SELECT count(*) FROM st WHERE day > as_of - 365 AND day <= as_of) AS missing, (SELECT min(day) FROM asm) AS a, (SELECT min(day) FROM gsm) AS g, as_of IN (SELECT day FROM asm) AS ia, as_of IN (SELECT day FROM gsm) AS ig FROM me),
r AS (SELECT as_of, CASE WHEN ever > 0 THEN missing END AS missing_days, concat_ws('; ', CASE WHEN ever = 0 THEN 'no price files' WHEN missing > 0 THEN missing || ' days without a price file' END,
  CASE WHEN a IS NULL THEN 'ASM never collected' WHEN a > as_of THEN 'ASM starts ' || a WHEN NOT ia THEN 'ASM not collected' END, CASE WHEN g IS NULL THEN 'GSM never collected' WHEN g > as_of THEN 'GSM starts ' || g WHEN NOT ig THEN 'GSM not collected' END) AS reasons FROM e)
SELECT as_of, missing_days, CASE WHEN missing_days IS NOT NULL AND reasons = '' THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, reasons FROM r""",
    "bt11_factor_sets": with_(BARS, ACTIONS) + """, o AS (SELECT instrument, ex_date, num, den FROM act WHERE ex_date <= DATE '1997-06-30' AND instrument % 10 <> 3),
n AS (SELECT instrument, ex_date, num + CASE WHEN instrument % 10 = 4 THEN 1 ELSE 0 END AS num, den FROM act WHERE ex_date <= DATE '1998-12-31' AND instrument % 10 <> 6 AND (instrument % 2 = 0 OR ex_date <= DATE '1997-06-30')),
x AS (SELECT instrument FROM ((SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL (SELECT * FROM n EXCEPT SELECT * FROM o)))
SELECT *, CASE WHEN instrument IN (FROM x) THEN 'CLOSED' ELSE 'KEPT' END AS state FROM o UNION ALL SELECT *, 'OPENED' FROM n WHERE instrument IN (FROM x)""",
    "dom67_long_uptrend": with_(*ALL) + """, ix AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i, exp(sum(coalesce(ln(1 + mean_return), 0)) OVER (ORDER BY trade_date)) AS index FROM days),
m AS (SELECT x.i, x.index > avg(y.index) AS above FROM ix x JOIN ix y ON y.i BETWEEN x.i - 49 AND x.i WHERE x.i >= 50 GROUP BY x.i, x.index)
SELECT trade_date, (SELECT count(*) FROM m WHERE m.i BETWEEN ix.i - 21 AND ix.i - 1 AND above) = 21 AS long_uptrend FROM ix""",
    "agg16_ic_summary": with_(BARS, STRENGTH, SCORED) + """, q AS (SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY rs_raw) + (count(*) OVER (PARTITION BY trade_date, rs_raw) - 1) / 2.0 AS a, rank() OVER (PARTITION BY trade_date ORDER BY outcome) + (count(*) OVER (PARTITION BY trade_date, outcome) - 1) / 2.0 AS b FROM outc),
i AS (SELECT corr(a, b) AS ic FROM q GROUP BY trade_date HAVING count(*) >= 10 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0)
SELECT count(*) AS dates, round(avg(ic) + 3e-10, 6) AS mean_ic, round(CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) * sqrt(count(*)) END + 3e-10, 6) AS t_stat FROM i""",
}
