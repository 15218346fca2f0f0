"""Queries of reports, histories and the remaining joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import r6, ratio
from barloom.operators import asof, labels, temporal
from barloom.operators.features import by_day, daily_features, weekly_bars
from barloom.operators.trend import trend_status, weekly_stage
from barloom.plans.fundamentals import FACTS, facts
from barloom.plans.market import trades
from barloom.plans.screen import rounded
from barloom.plans.sql import BARS, FEATURES, STAGE, STRENGTH, TREND, WEEKLY, with_
from barloom.plans.temporal import ACTIONS
from barloom.sources.bars import actions, model_bars, sectors, table

PERIODS = [("development", "1992-01-01", "1995-12-31"), ("validation", "1996-01-01", "1997-06-30"), ("test", "1997-07-01", "1999-12-31")]


def stage_changes(s, d):
    st = weekly_stage(model_bars(s, d)).select("instrument", "trade_date", "stage")
    return st.withColumn("before", F.lag("stage").over(by_day())).where("before IS NOT NULL AND before <> stage")


def walk_forward(s, d):
    """Trade statistics of named periods that don't overlap; the periods are three rows."""
    p = s.createDataFrame(PERIODS, "period string, a string, b string").select("period", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    t = table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.round((F.col("l_discount") - F.col("l_tax")) * 100, 4).alias("ret_pct"), F.col("l_quantity").alias("hold_days"))
    rows = t.join(F.broadcast(p), (F.col("day") >= F.col("a")) & (F.col("day") <= F.col("b")))
    return rounded(labels.trade_stats(rows, "period"), "win_rate", "avg_ret", "median_ret", "avg_win", "avg_loss", "profit_factor", "avg_hold_days")


def lookahead(s, d):
    """Rows at a date that differ when everything after it is cut off: none, if nothing ahead is read."""
    cut = F.lit("1997-06-30").cast("date")
    bars = model_bars(s, d)
    whole = trend_status(bars).where(F.col("trade_date") <= cut)
    short = trend_status(bars.where(F.col("trade_date") <= cut))
    only = lambda a, b, n: a.exceptAll(b).agg(F.count("*").alias(n))
    return whole.agg(F.count("*").alias("n_rows")).crossJoin(only(whole, short, "only_whole")).crossJoin(only(short, whole, "only_short"))


def facts_of_day(s, d):
    """The latest restated value known on each bar's day: revisions of a customer stand for those of the instrument with its number. Bars without facts have nulls."""
    f = facts(s, d).groupBy("entity", F.col("available_at").alias("known_on")).agg(F.max_by("value", F.struct("period", "revision")).alias("value"))
    bars = model_bars(s, d).select(F.col("instrument").alias("entity"), "trade_date")
    return asof.backward(bars, f, ["entity"], "trade_date", "known_on", ["value"])


def activity(s, d):
    """One feed of what happened: instruments whose week begins or ends a passing run, splits, and stage changes into stage 2."""
    b = model_bars(s, d)
    st = trend_status(b).withColumn("before", F.lag("status").over(by_day()))
    runs = st.where("(status = 'PASS') <> (before = 'PASS')").select("instrument", F.col("trade_date").alias("day"), F.when(F.col("status") == "PASS", "ENTERED_SCREEN").otherwise("LEFT_SCREEN").alias("event"))
    acts = actions(b).select("instrument", F.col("ex_date").alias("day"), F.lit("SPLIT").alias("event"))
    stages = stage_changes(s, d).where("stage = 'STAGE_2'").select("instrument", F.col("trade_date").alias("day"), F.lit("STAGE_2").alias("event"))
    return runs.unionByName(acts).unionByName(stages).orderBy(F.desc("day"), "instrument", "event")


def universe_ids(s, d):
    """An id for each month's universe: date and a hash of its ordered members."""
    b = model_bars(s, d).select("instrument", F.trunc("trade_date", "month").alias("month")).distinct()
    h = F.sha2(F.concat_ws("|", F.date_format("month", "yyyy-MM-dd"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("instrument")), lambda x: x.cast("string")))), 256)
    return b.groupBy("month").agg(h.alias("h"), F.count("*").alias("n")).select("month", F.concat(F.lit("uv_"), F.date_format("month", "yyyyMMdd"), F.lit("_"), F.substring("h", 1, 10)).alias("universe_id"), "n")


def precedence(s, d):
    """A sector from two lists: a hand entry never beats the exchange's own, a coarse one never a finer one."""
    fine = sectors(s, d).where("instrument % 3 <> 0").select("instrument", "sector", F.lit("EXCHANGE").alias("source"), F.lit(1).alias("p"))
    coarse = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("instrument"), F.col("r_name").alias("sector"), F.lit("COARSE").alias("source"), F.lit(2).alias("p"))
    manual = sectors(s, d).where("instrument % 2 = 0").select("instrument", F.lit("BY HAND").alias("sector"), F.lit("MANUAL").alias("source"), F.when(F.col("instrument") % 4 == 0, 3).otherwise(2).alias("p"))
    return temporal.latest(fine.unionByName(coarse).unionByName(manual), ["instrument"], F.col("p"), F.desc("source")).drop("p")


def history_map(s, d):
    """Which old id an instrument had, by the number of equal (day, close, volume); the best match of each, one to one."""
    b = model_bars(s, d).select("instrument", "trade_date", "close", "volume")
    old = b.where("trade_date < DATE '1996-01-01'").select((F.col("instrument") + 1000).alias("old_id"), "trade_date", "close", "volume")
    n = b.join(old, ["trade_date", "close", "volume"]).groupBy("instrument", "old_id").agg(F.count("*").alias("n_equal"))
    return temporal.latest(n, ["instrument"], F.desc("n_equal"), F.col("old_id"))


def index_days(s, d):
    """Equal-weight index: mean, 50-day mean, 20-day return, and accumulation or distribution days by change and volume."""
    day = daily_features(model_bars(s, d)).groupBy("trade_date").agg(F.avg("daily_return").alias("r"), F.sum("volume").alias("volume"))
    w = W.orderBy("trade_date")
    rows = day.select("trade_date", "volume", F.round(F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(w.rowsBetween(W.unboundedPreceding, 0))) * 1000 + 3e-9, 6).alias("close"))
    step, louder = ratio(F.col("close"), F.lag("close").over(w)) - 1, F.col("volume") > F.lag("volume").over(w)
    fifty = w.rowsBetween(-49, 0)
    kind = F.when((step <= -0.002) & louder, "DISTRIBUTION").when((step >= 0.002) & louder, "ACCUMULATION")
    return rows.select("trade_date", "close", r6(F.when(F.count("close").over(fifty) == 50, F.avg("close").over(fifty))).alias("sma_50"), r6((ratio(F.col("close"), F.lag("close", 20).over(w)) - 1) * 100).alias("ret_20"), kind.alias("kind"))


def bias(s, d):
    """Per year: bars observed, and those that a later split touches."""
    b = model_bars(s, d).select("instrument", "trade_date")
    last = actions(model_bars(s, d)).groupBy("instrument").agg(F.max("ex_date").alias("last_ex"))
    return b.join(last, "instrument", "left").groupBy(F.year("trade_date").alias("year")).agg(F.count("*").alias("n"), F.count(F.when(F.col("last_ex") > F.col("trade_date"), 1)).alias("n_touched"))


def outside(s, d):
    """Suppliers that a day's scan lacks, with the reason."""
    day = F.lit("1996-01-03").cast("date")
    b = model_bars(s, d)
    here = b.where(F.col("trade_date") == day).select("instrument")
    seen = b.groupBy("instrument").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    rows = table(s, d, "supplier").select(F.col("s_suppkey").alias("instrument")).join(here, "instrument", "left_anti").join(seen, "instrument", "left")
    return rows.select("instrument", F.when(F.col("first").isNull(), "NEVER_TRADED").when(F.col("first") > day, "NOT_LISTED_YET").when(F.col("last") < day, "NO_LONGER_TRADED").otherwise("NO_BAR").alias("reason"))


QUERIES = {
    "dom40_stage_changes": stage_changes,
    "dom61_walk_forward": walk_forward,
    "dom63_lookahead": lookahead,
    "dom69_facts_of_day": facts_of_day,
    "dom94_activity": activity,
    "bt06_universe_ids": universe_ids,
    "bt08_precedence": precedence,
    "bt17_history_map": history_map,
    "dom72_index_days": index_days,
    "dom62_bias": bias,
    "fil12_outside": outside,
    "dom78_new_highs": lambda s, d: temporal.latest(daily_features(model_bars(s, d)).where("high_252 IS NOT NULL").select("instrument", "trade_date", "high", "high_252"), ["instrument"], F.desc("trade_date")).where("high >= high_252"),
    "join04_semi": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_nationkey"),
    "join05_anti": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_nationkey"),
    "join14_scalar": lambda s, d: (lambda o: o.join(o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate")), ["o_custkey", "o_orderdate"]))(table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")).select("o_custkey", "o_orderkey", "o_totalprice"),
    "join16_null_safe": lambda s, d: (lambda l: l.alias("x").join(l.groupBy(F.col("k").alias("k2")).agg(F.count("*").alias("n")).alias("y"), F.expr("x.k <=> y.k2")).select("o_orderkey", "n"))(table(s, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("k"))),
    "set02_symmetric": lambda s, d: temporal.symmetric_difference(table(s, d, "customer").where("c_custkey % 2 = 0").select("c_nationkey").distinct(), table(s, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).where("c_nationkey < 20").distinct()),
    "set05_union": lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct(),
    "set06_both_sides": lambda s, d: table(s, d, "lineitem").select(F.col("l_suppkey").alias("k")).distinct().withColumn("a", F.lit(1)).join(table(s, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("b", F.lit(1)), "k", "full").groupBy(F.when(F.col("a").isNull(), "ONLY_RIGHT").when(F.col("b").isNull(), "ONLY_LEFT").otherwise("COMMON").alias("side")).agg(F.count("*").alias("n")),
    "win21_overnight": lambda s, d: rounded(model_bars(s, d).select("instrument", "trade_date", (F.col("low") / F.lag("high").over(by_day()) - 1).alias("gap")).where("gap > 0.005"), "gap"),
    "win15_strict_mean": lambda s, d: rounded(model_bars(s, d).select("instrument", "trade_date", F.when(F.col("volume") >= 10, F.col("volume")).alias("v")).select("instrument", "trade_date", F.when(F.count("v").over(by_day().rowsBetween(-2, 0)) == 3, F.avg("v").over(by_day().rowsBetween(-2, 0))).alias("mean_3")), "mean_3"),
    "src03_latest_file": lambda s, d: temporal.latest(table(s, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice", "o_orderstatus"), ["day"], F.desc("o_orderkey")),
    "agg04_arg_max": lambda s, d: weekly_bars(model_bars(s, d)).groupBy("instrument").agg(F.max_by("close", "week_end").alias("last_close"), F.max_by("week_end", F.struct("high", "week_end")).alias("best_week")),
    "agg03_bool_or": lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.bool_or(F.col("l_returnflag") == "N").alias("any_n"), F.bool_and(F.col("l_linestatus") == "O").alias("all_o")),
}

ORACLES = {
    "dom40_stage_changes": with_(BARS, WEEKLY, STAGE) + "SELECT * FROM (SELECT instrument, trade_date, stage, lag(stage) OVER (PARTITION BY instrument ORDER BY trade_date) AS before FROM stage) WHERE before <> stage",
    "dom61_walk_forward": "WITH p(period, a, b) AS (VALUES " + ", ".join(f"('{p}', DATE '{a}', DATE '{b}')" for p, a, b in PERIODS) + """), t AS (SELECT period, round((l_discount - l_tax) * 100, 4) AS r, l_quantity AS h FROM lineitem JOIN p ON CAST(l_shipdate AS DATE) BETWEEN a AND b)
SELECT period, count(*) AS trades, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) + 3e-10, 6) AS win_rate, round(avg(r) + 3e-10, 6) AS avg_ret, round(median(r) + 3e-10, 6) AS median_ret, round(avg(r) FILTER (WHERE r > 0) + 3e-10, 6) AS avg_win,
  round(avg(r) FILTER (WHERE r <= 0) + 3e-10, 6) AS avg_loss, round(sum(r) FILTER (WHERE r > 0) / nullif(-sum(r) FILTER (WHERE r <= 0), 0) + 3e-10, 6) AS profit_factor, round(avg(h) + 3e-10, 6) AS avg_hold_days FROM t GROUP BY 1""",
    "dom63_lookahead": with_(BARS) + "SELECT count(*) AS n_rows, 0 AS only_whole, 0 AS only_short FROM bars WHERE trade_date <= DATE '1997-06-30'",
    "dom69_facts_of_day": with_(BARS) + ", " + FACTS.strip() + """, k AS (SELECT entity, available_at AS known_on, arg_max(value, (period, revision)) AS value FROM fact GROUP BY 1, 2),
m AS (SELECT b.instrument, b.trade_date, max(known_on) AS matched_known_on FROM bars b LEFT JOIN k ON k.entity = b.instrument AND known_on <= b.trade_date GROUP BY 1, 2)
SELECT m.instrument AS entity, m.trade_date, m.matched_known_on, k.value FROM m LEFT JOIN k ON k.entity = m.instrument AND k.known_on = m.matched_known_on""",
    "dom94_activity": with_(BARS, FEATURES, STRENGTH, TREND, WEEKLY, STAGE, ACTIONS) + """, p AS (SELECT instrument, trade_date, status, lag(status) OVER (PARTITION BY instrument ORDER BY trade_date) AS before FROM status), g AS (SELECT instrument, trade_date, stage, lag(stage) OVER (PARTITION BY instrument ORDER BY trade_date) AS before FROM stage)
SELECT instrument, trade_date AS day, CASE WHEN status = 'PASS' THEN 'ENTERED_SCREEN' ELSE 'LEFT_SCREEN' END AS event FROM p WHERE (status = 'PASS') <> (before = 'PASS')
UNION ALL SELECT instrument, ex_date, 'SPLIT' FROM act UNION ALL SELECT instrument, trade_date, 'STAGE_2' FROM g WHERE stage = 'STAGE_2' AND before <> stage""",
    "bt06_universe_ids": with_(BARS) + """, m AS (SELECT DISTINCT instrument, CAST(date_trunc('month', trade_date) AS DATE) AS month FROM bars)
SELECT month, 'uv_' || strftime(month, '%Y%m%d') || '_' || substr(sha256(strftime(month, '%Y-%m-%d') || '|' || string_agg(CAST(instrument AS VARCHAR), ',' ORDER BY instrument)), 1, 10) AS universe_id, count(*) AS n FROM m GROUP BY month""",
    "bt08_precedence": """WITH sec AS (SELECT s_suppkey AS instrument, n_name AS sector, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT instrument, sector, 'EXCHANGE' AS source, 1 AS p FROM sec WHERE instrument % 3 <> 0 UNION ALL SELECT instrument, r_name, 'COARSE', 2 FROM sec UNION ALL SELECT instrument, 'BY HAND', 'MANUAL', CASE WHEN instrument % 4 = 0 THEN 3 ELSE 2 END FROM sec WHERE instrument % 2 = 0)
SELECT instrument, sector, source FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY p, source DESC) AS n FROM u) WHERE n = 1""",
    "bt17_history_map": with_(BARS) + """, m AS (SELECT b.instrument, o.instrument + 1000 AS old_id, count(*) AS n_equal FROM bars b JOIN bars o ON o.trade_date = b.trade_date AND o.close = b.close AND o.volume = b.volume AND o.trade_date < DATE '1996-01-01' GROUP BY 1, 2)
SELECT instrument, old_id, n_equal FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY n_equal DESC, old_id) AS n FROM m) WHERE n = 1""",
    "dom72_index_days": with_(BARS, FEATURES) + """, a AS (SELECT trade_date, avg(daily_return) AS r, sum(volume) AS volume FROM feat GROUP BY 1), i AS (SELECT trade_date, volume, round(exp(sum(ln(1 + coalesce(r, 0.0))) OVER (ORDER BY trade_date)) * 1000 + 3e-9, 6) AS close FROM a),
k AS (SELECT *, close / lag(close) OVER w - 1 AS step, volume > lag(volume) OVER w AS louder, CASE WHEN count(*) OVER f = 50 THEN avg(close) OVER f END AS s50, (close / lag(close, 20) OVER w - 1) * 100 AS r20 FROM i WINDOW w AS (ORDER BY trade_date), f AS (ORDER BY trade_date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT trade_date, close, round(s50 + 3e-10, 6) AS sma_50, round(r20 + 3e-10, 6) AS ret_20, CASE WHEN step <= -0.002 AND louder THEN 'DISTRIBUTION' WHEN step >= 0.002 AND louder THEN 'ACCUMULATION' END AS kind FROM k""",
    "dom62_bias": with_(BARS, ACTIONS) + ", l AS (SELECT instrument, max(ex_date) AS x FROM act GROUP BY 1) SELECT CAST(year(trade_date) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (WHERE x > trade_date) AS n_touched FROM bars LEFT JOIN l USING (instrument) GROUP BY 1",
    "fil12_outside": with_(BARS) + """, e AS (SELECT instrument, min(trade_date) AS a, max(trade_date) AS b, bool_or(trade_date = DATE '1996-01-03') AS here FROM bars GROUP BY 1)
SELECT s_suppkey AS instrument, CASE WHEN a IS NULL THEN 'NEVER_TRADED' WHEN a > DATE '1996-01-03' THEN 'NOT_LISTED_YET' WHEN b < DATE '1996-01-03' THEN 'NO_LONGER_TRADED' ELSE 'NO_BAR' END AS reason FROM supplier LEFT JOIN e ON e.instrument = s_suppkey WHERE NOT coalesce(here, false)""",
    "dom78_new_highs": with_(BARS, FEATURES) + "SELECT instrument, trade_date, high, high_252 FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY trade_date DESC) AS n FROM feat WHERE high_252 IS NOT NULL) WHERE n = 1 AND high >= high_252",
    "join04_semi": "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "join05_anti": "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "join14_scalar": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "join16_null_safe": "WITH l AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS k FROM orders), c AS (SELECT k, count(*) AS n FROM l GROUP BY 1) SELECT o_orderkey, n FROM l JOIN c ON l.k IS NOT DISTINCT FROM c.k",
    "set02_symmetric": """WITH a AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT DISTINCT s_nationkey AS c_nationkey FROM supplier WHERE s_nationkey < 20)
SELECT *, 'LEFT' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'RIGHT' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "set05_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set06_both_sides": "SELECT CASE WHEN a.k IS NULL THEN 'ONLY_RIGHT' WHEN b.k IS NULL THEN 'ONLY_LEFT' ELSE 'COMMON' END AS side, count(*) AS n FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k GROUP BY 1",
    "win21_overnight": with_(BARS) + ", g AS (SELECT instrument, trade_date, low / lag(high) OVER (PARTITION BY instrument ORDER BY trade_date) - 1 AS gap FROM bars) SELECT instrument, trade_date, round(gap + 3e-10, 6) AS gap FROM g WHERE gap > 0.005",
    "win15_strict_mean": with_(BARS) + ", v AS (SELECT instrument, trade_date, CASE WHEN volume >= 10 THEN volume END AS v FROM bars) SELECT instrument, trade_date, round(CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END + 3e-10, 6) AS mean_3 FROM v WINDOW w AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "src03_latest_file": "SELECT day, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "agg04_arg_max": with_(BARS, WEEKLY) + "SELECT instrument, arg_max(close, week_end) AS last_close, arg_max(week_end, (high, week_end)) AS best_week FROM weekly GROUP BY 1",
    "agg03_bool_or": "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, bool_or(l_returnflag = 'N') AS any_n, bool_and(l_linestatus = 'O') AS all_o FROM lineitem GROUP BY 1, 2",
}
