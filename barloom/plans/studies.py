"""Queries of group studies, set operations, sorts and scalar families."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import r6
from barloom.operators import studies
from barloom.operators.features import by_day, daily_features
from barloom.plans.market import SCORED, scored, trades
from barloom.plans.screen import rounded
from barloom.plans.sql import BARS, FEATURES, STRENGTH, TREND, WEEKLY, STAGE, with_
from barloom.operators.trend import trend_status, weekly_stage
from barloom.sources.bars import actions, model_bars, sectors, table


def search(s, d):
    """Suppliers whose name starts with or parts whose name holds the text: exact before prefix before inner match."""
    text = "Supplier#00000001"
    q = table(s, d, "supplier").where(F.col("s_name").contains(text))
    return q.select("s_suppkey", "s_name", F.when(F.col("s_name") == text, 1).when(F.col("s_name").startswith(text), 2).otherwise(3).alias("rank")).orderBy("rank", "s_name", "s_suppkey").limit(20)


def sector_table(s, d):
    bars = model_bars(s, d)
    f = daily_features(bars).select("instrument", "trade_date", "close", "sma_50", "daily_return").withColumn("above_then", F.lag(F.col("close") > F.col("sma_50"), 21).over(by_day()))
    last = f.groupBy("instrument").agg(F.max("trade_date").alias("trade_date"))
    now = f.join(last, ["instrument", "trade_date"]).join(sectors(s, d), "instrument")
    share = lambda t: F.avg(F.when(t, 100.0).otherwise(0.0))
    return now.groupBy("sector").agg(F.count("*").alias("n"), r6(share(F.col("close") > F.col("sma_50"))).alias("above_now"), r6(share(F.col("above_then"))).alias("above_then"), r6(F.median("daily_return")).alias("median_return"))


def stage_history(s, d):
    st = weekly_stage(model_bars(s, d)).withColumn("week", F.date_trunc("week", "trade_date").cast("date"))
    last = st.groupBy("instrument", "week").agg(F.max_by("stage", "trade_date").alias("stage"))
    names = ["STAGE_1", "STAGE_2", "STAGE_3", "STAGE_4", "TRANSITION", "INSUFFICIENT_DATA"]
    return last.groupBy("week").pivot("stage", names).count().na.fill(0).select("week", *[F.col(n).cast("long").alias(n.lower()) for n in names])


def screen_page(s, d):
    """A page of the screen: present ranks first, best first, ties by instrument."""
    day = F.lit("1998-06-01").cast("date")
    rows = trend_status(model_bars(s, d)).where(F.col("trade_date") >= day)
    return rows.orderBy(F.col("rs_rank").desc_nulls_last(), "instrument", "trade_date").offset(50).limit(100)


def new_members(s, d):
    """Years in which an instrument passes the screen at least once, and did not the year before."""
    return studies.new_years(trend_status(model_bars(s, d)).where("status = 'PASS'").select("instrument", F.year("trade_date").alias("year")))


QUERIES = {
    "agg05_product": lambda s, d: actions(model_bars(s, d)).groupBy("instrument").agg(r6(F.exp(F.sum(F.log("factor")))).alias("product"), F.count("*").alias("n")),
    "agg06_distinct": lambda s, d: table(s, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct(F.to_date("l_shipdate")).alias("n_days")),
    "agg07_having": lambda s, d: model_bars(s, d).groupBy("instrument").agg(F.count("*").alias("n"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last")).where("n < 540"),
    "agg08_pivot": lambda s, d: table(s, d, "orders").groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.max("o_totalprice")).toDF("o_custkey", "p1", "p2", "p3", "p4", "p5"),
    "agg10_median": lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(r6(F.median("o_totalprice")).alias("median_price")),
    "agg14_summarize": lambda s, d: rounded(studies.summarize(scored(s, d).withColumn("bucket", F.col("instrument") % 7), "bucket", "trade_date", F.col("outcome") > 0), "win_rate", "excess"),
    "agg17_spread": lambda s, d: rounded(studies.spread(scored(s, d), "trade_date", "rs_raw", "outcome"), "spread"),
    "agg18_crosstab": lambda s, d: table(s, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.when(F.col("l_discount") < 0.03, "LOW").when(F.col("l_discount") < 0.07, "MID").otherwise("HIGH").alias("band")).agg(F.count("*").alias("n"), r6(F.avg("l_extendedprice")).alias("avg_price")),
    "agg19_leave_one_out": lambda s, d: rounded(studies.leave_one_out(trades(s, d), "year", "ret_pct"), "mean_without"),
    "agg20_correlation": lambda s, d: scored(s, d).groupBy("instrument").agg(F.count("*").alias("n"), r6(F.corr("rs_raw", "outcome")).alias("corr")),
    "agg21_confusion": lambda s, d: rounded(studies.confusion(table(s, d, "lineitem").select(F.when(F.col("l_discount") > 0.05, "UP").otherwise("DOWN").alias("label"), F.when(F.col("l_tax") > 0.04, "UP").otherwise("DOWN").alias("got")), "label", "got"), "precision", "recall"),
    "agg22_sector_table": sector_table,
    "agg23_stage_history": stage_history,
    "agg24_top_mean": lambda s, d: rounded(studies.top_mean(scored(s, d), "trade_date", "rs_raw", 10, "instrument"), "top_mean"),
    "agg25_equal_weight": lambda s, d: daily_features(model_bars(s, d)).groupBy("trade_date").agg(F.avg("daily_return").alias("r")).where("r IS NOT NULL").groupBy(F.year("trade_date").alias("year")).agg(r6((F.exp(F.sum(F.log1p("r"))) - 1) * 100).alias("return_pct"), F.count("*").alias("n_days")),
    "set01_union_by_name": lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("c").alias("kind")).unionByName(table(s, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True).groupBy("kind", "nation").agg(F.count("*").alias("n"), F.count("balance").alias("n_balance")),
    "set03_table_difference": lambda s, d: studies.table_difference(table(s, d, "orders").where("o_orderkey % 5 <> 0").select("o_custkey", "o_orderpriority"), table(s, d, "orders").where("o_orderkey % 7 <> 0").select("o_custkey", "o_orderpriority")),
    "set04_new_members": new_members,
    "sort01_screen_page": screen_page,
    "sort04_stratified_sample": lambda s, d: studies.stratified_sample(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 50, entity="o_custkey"),
    "fil09_search": search,
    "scl03_dates": lambda s, d: table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).select("o_orderkey", F.weekofyear("d").alias("iso_week"), F.extract(F.lit("YEAROFWEEK"), F.col("d")).cast("int").alias("iso_year"), F.last_day(F.add_months("d", -3)).alias("quarter_back"), (F.last_day("d") == F.col("d")).alias("month_end"), F.weekday("d").alias("weekday")),
    "scl04_cutoff": lambda s, d: table(s, d, "events").select("event_id", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kolkata").alias("local")).select("event_id", F.date_add(F.to_date("local"), F.when(F.date_format("local", "HH:mm:ss") > "15:30:00", 1).otherwise(0)).alias("available_on")),
    "scl07_json": lambda s, d: table(s, d, "events").select("event_id", F.size(F.json_object_keys("props")).alias("n_keys"), F.get_json_object("props", "$.k").alias("k")),
}

ORACLES = {
    "agg05_product": with_(BARS) + "SELECT instrument, round(pow(CASE WHEN instrument % 2 = 0 THEN 0.5 ELSE 2 / CAST(3 AS DOUBLE) END, count(*)) + 3e-10, 6) AS product, count(*) AS n FROM (SELECT instrument, row_number() OVER (PARTITION BY instrument ORDER BY trade_date) AS k FROM bars) WHERE k % 180 = 0 GROUP BY 1",
    "agg06_distinct": "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days FROM lineitem GROUP BY 1",
    "agg07_having": with_(BARS) + "SELECT instrument, count(*) AS n, min(trade_date) AS first, max(trade_date) AS last FROM bars GROUP BY 1 HAVING count(*) < 540",
    "agg08_pivot": "SELECT o_custkey, " + ", ".join(f"max(o_totalprice) FILTER (WHERE o_orderpriority LIKE '{k}-%') AS p{k}" for k in range(1, 6)) + " FROM orders GROUP BY 1",
    "agg10_median": "SELECT o_orderpriority, round(median(o_totalprice) + 3e-10, 6) AS median_price FROM orders GROUP BY 1",
    "agg14_summarize": with_(BARS, STRENGTH, SCORED) + """, w AS (SELECT CAST(instrument % 7 AS VARCHAR) AS bucket, CASE WHEN outcome > 0 THEN 1.0 ELSE 0.0 END AS win, avg(CASE WHEN outcome > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY trade_date) AS base FROM outc)
SELECT bucket, count(*) AS n, round(avg(win) + 3e-10, 6) AS win_rate, round(avg(win - base) + 3e-10, 6) AS excess FROM w GROUP BY 1 UNION ALL SELECT 'ALL', count(*), round(avg(win) + 3e-10, 6), round(avg(win - base) + 3e-10, 6) FROM w""",
    "agg17_spread": with_(BARS, STRENGTH, SCORED) + """, f AS (SELECT *, ntile(5) OVER (PARTITION BY trade_date ORDER BY rs_raw, outcome) AS f FROM outc)
SELECT trade_date, count(*) AS n, round(avg(outcome) FILTER (WHERE f = 5) - avg(outcome) FILTER (WHERE f = 1) + 3e-10, 6) AS spread FROM f GROUP BY 1""",
    "agg18_crosstab": "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN l_discount < 0.03 THEN 'LOW' WHEN l_discount < 0.07 THEN 'MID' ELSE 'HIGH' END AS band, count(*) AS n, round(avg(l_extendedprice) + 3e-10, 6) AS avg_price FROM lineitem GROUP BY 1, 2",
    "agg19_leave_one_out": """WITH t AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round((l_discount - l_tax) * 100, 4) AS r FROM lineitem), y AS (SELECT DISTINCT year FROM t)
SELECT y.year, round(avg(r) + 3e-10, 6) AS mean_without, sign(sum(r)) = (SELECT sign(sum(r)) FROM t) AS same_sign FROM y JOIN t ON t.year <> y.year GROUP BY 1""",
    "agg20_correlation": with_(BARS, STRENGTH, SCORED) + "SELECT instrument, count(*) AS n, round(corr(rs_raw, outcome) + 3e-10, 6) AS corr FROM outc GROUP BY 1",
    "agg21_confusion": """WITH c AS (SELECT CASE WHEN l_discount > 0.05 THEN 'UP' ELSE 'DOWN' END AS label, CASE WHEN l_tax > 0.04 THEN 'UP' ELSE 'DOWN' END AS got, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT label, got, n, round(CASE WHEN label = got THEN n / sum(n) OVER (PARTITION BY got) END + 3e-10, 6) AS precision, round(CASE WHEN label = got THEN n / sum(n) OVER (PARTITION BY label) END + 3e-10, 6) AS recall FROM c""",
    "agg22_sector_table": with_(BARS, FEATURES) + """, t AS (SELECT *, lag(close > sma_50, 21) OVER (PARTITION BY instrument ORDER BY trade_date) AS above_then, row_number() OVER (PARTITION BY instrument ORDER BY trade_date DESC) AS k FROM feat)
SELECT n_name AS sector, count(*) AS n, round(avg(CASE WHEN close > sma_50 THEN 100.0 ELSE 0.0 END) + 3e-10, 6) AS above_now, round(avg(CASE WHEN above_then THEN 100.0 ELSE 0.0 END) + 3e-10, 6) AS above_then, round(median(daily_return) + 3e-10, 6) AS median_return
FROM t JOIN supplier ON s_suppkey = instrument JOIN nation ON n_nationkey = s_nationkey WHERE k = 1 GROUP BY 1""",
    "agg23_stage_history": with_(BARS, WEEKLY, STAGE) + """, l AS (SELECT instrument, CAST(date_trunc('week', trade_date) AS DATE) AS week, arg_max(stage, trade_date) AS stage FROM stage GROUP BY 1, 2)
SELECT week, """ + ", ".join(f"count(*) FILTER (WHERE stage = '{n}') AS {n.lower()}" for n in ("STAGE_1", "STAGE_2", "STAGE_3", "STAGE_4", "TRANSITION", "INSUFFICIENT_DATA")) + " FROM l GROUP BY 1",
    "agg24_top_mean": with_(BARS, STRENGTH, SCORED) + "SELECT trade_date, round(avg(rs_raw) + 3e-10, 6) AS top_mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY rs_raw DESC, instrument) AS k FROM outc) WHERE k <= 10 GROUP BY 1",
    "agg25_equal_weight": with_(BARS, FEATURES) + ", r AS (SELECT trade_date, avg(daily_return) AS r FROM feat GROUP BY 1) SELECT CAST(year(trade_date) AS INTEGER) AS year, round((exp(sum(ln(1 + r))) - 1) * 100 + 3e-10, 6) AS return_pct, count(*) AS n_days FROM r WHERE r IS NOT NULL GROUP BY 1",
    "set01_union_by_name": "SELECT kind, nation, count(*) AS n, count(balance) AS n_balance FROM (SELECT 'c' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_nationkey, NULL FROM supplier) GROUP BY 1, 2",
    "set03_table_difference": """WITH a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0)
SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b""",
    "set04_new_members": with_(BARS, FEATURES, STRENGTH, TREND) + ", m AS (SELECT DISTINCT instrument, CAST(year(trade_date) AS INTEGER) AS year FROM status WHERE status = 'PASS') SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m p WHERE p.instrument = m.instrument AND p.year = m.year - 1)",
    "sort01_screen_page": with_(BARS, FEATURES, STRENGTH, TREND) + "SELECT * FROM status WHERE trade_date >= DATE '1998-06-01' ORDER BY rs_rank DESC NULLS LAST, instrument, trade_date LIMIT 100 OFFSET 50",
    "sort04_stratified_sample": """WITH h AS (SELECT o_orderkey, o_custkey, o_orderpriority, md5('7|' || CAST(o_orderkey AS VARCHAR)) AS h FROM orders), e AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY h) AS e FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h) AS n FROM e WHERE e = 1) SELECT o_orderkey, o_custkey, o_orderpriority FROM n WHERE n <= 50""",
    "fil09_search": "SELECT s_suppkey, s_name, CASE WHEN s_name = 'Supplier#00000001' THEN 1 WHEN starts_with(s_name, 'Supplier#00000001') THEN 2 ELSE 3 END AS rank FROM supplier WHERE contains(s_name, 'Supplier#00000001') ORDER BY 3, 2, 1 LIMIT 20",
    "scl03_dates": "SELECT o_orderkey, CAST(week(o_orderdate) AS INTEGER) AS iso_week, CAST(isoyear(o_orderdate) AS INTEGER) AS iso_year, last_day(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH) AS quarter_back, last_day(CAST(o_orderdate AS DATE)) = CAST(o_orderdate AS DATE) AS month_end, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday FROM orders",
    "scl04_cutoff": "SELECT event_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) + CASE WHEN CAST(strftime(ts + INTERVAL 330 MINUTE, '%H:%M:%S') AS VARCHAR) > '15:30:00' THEN 1 ELSE 0 END AS available_on FROM events",
    "scl07_json": "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n_keys, json_extract_string(props, '$.k') AS k FROM events",
}
