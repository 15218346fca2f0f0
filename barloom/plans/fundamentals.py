"""Queries of point-in-time fundamentals; orders are a customer's filings, quarters their periods."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import r6
from barloom.operators import fundamentals as fu
from barloom.operators import quarters
from barloom.plans.screen import rounded
from barloom.sources.bars import table


def facts(s, d):
    """Every order restates its customer's quarter: revision by date, value the running sum of prices in it."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("entity"), F.date_trunc("quarter", F.to_date("o_orderdate")).cast("date").alias("period"), F.to_date("o_orderdate").alias("available_at"), "o_orderkey", "o_totalprice")
    w = W.partitionBy("entity", "period").orderBy("available_at", "o_orderkey")
    return o.select("entity", "period", (F.row_number().over(w) - 1).alias("revision"), "available_at", F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)) + 3e-5, 2).alias("value"))


def latest(s, d):
    return fu.usable(facts(s, d)).select("entity", "period", "value")


def ytd(s, d):
    w = W.partitionBy("entity", F.year("period")).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    return latest(s, d).select("entity", "period", F.round(F.sum("value").over(w) + 3e-5, 2).alias("value"))


def shares(s, d):
    l = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.date_trunc("quarter", F.to_date("l_shipdate")).cast("date").alias("period"), F.when(F.col("l_returnflag") == "N", "A").when(F.col("l_returnflag") == "A", "B").otherwise("C").alias("part")).agg(F.sum("l_quantity").alias("q"))
    return l.select("entity", "period", "part", F.round(F.col("q") / F.sum("q").over(W.partitionBy("entity", "period")) * 100 + 3e-7, 4).alias("pct"))


CUTOFF = "1998-06-30"


def snapshots(s, d):
    """Every restatement as filings of both bases: consolidated ones lack for one customer in three, and for another one from 1997 on; some are invalid."""
    f = facts(s, d)
    i, v = F.col("entity") % 3, F.col("value")
    both = f.withColumn("basis", F.explode(F.array(F.lit("STANDALONE"), F.lit("CONSOLIDATED")))).where((F.col("basis") == "STANDALONE") | (i == 2) | ((i == 1) & (F.col("period") < F.lit("1997-01-01").cast("date"))))
    both = both.withColumn("value", v * F.when(F.col("basis") == "CONSOLIDATED", 1.25).otherwise(1.0))
    parts = {"revenue": 1.0, "eps": 0.001, "net_profit": 0.1, "pbt": 0.15, "finance_costs": 0.01, "depreciation": 0.02, "other_income": 0.005}
    status = F.when((F.col("entity") + F.col("revision")) % 11 == 5, "INVALID").otherwise("OK")
    return both.select("entity", F.last_day(F.add_months("period", 2)).alias("period_end"), "basis", "revision", "available_at", status.alias("status"), *[(v * k).alias(n) for n, k in parts.items()], (F.col("entity") % 5 == 0).alias("is_financial"))


def share_actions(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("entity"))
    row = lambda test, day: c.where(test).select("entity", F.lit(day).cast("date").alias("ex_date"), F.lit(0.5).alias("factor"))
    return row("entity % 4 = 0", "1996-07-01").unionByName(row("entity % 6 = 0", "1997-04-01"))


def history(s, d):
    return quarters.quarter_history(snapshots(s, d), share_actions(s, d), CUTOFF)


VALUES = ["revenue", "eps", "eps_as_filed", "operating_margin", "net_margin", "eps_yoy", "sales_yoy"]


def screen(s, d):
    views = quarters.current_views(history(s, d), CUTOFF)
    return quarters.screened_views(views, min_eps_yoy=0.0, min_sales_yoy=-50.0, accelerating=True, current_only=True)


SHARE = [f"{c}{k}" for c in "ABC" for k in ("", "_change", "_change_4")]

QUERIES = {
    "dom88_quarter_history": lambda s, d: rounded(history(s, d), *VALUES),
    "dom87_current_views": lambda s, d: rounded(quarters.current_views(history(s, d), CUTOFF), *VALUES, "eps_acceleration"),
    "fil08_fundamentals_screen": lambda s, d: rounded(screen(s, d), *VALUES, "eps_acceleration"),
    "dom85_facts": facts,
    "dom86_usable": lambda s, d: fu.usable(facts(s, d), "1997-02-10"),
    "dom85_quarters": lambda s, d: rounded(fu.quarter_of_ytd(ytd(s, d)), "quarter_value"),
    "dom87_growth": lambda s, d: rounded(fu.growth(latest(s, d)), "yoy", "qoq", "ttm"),
    "dom91_holdings": lambda s, d: rounded(fu.holding_summary(shares(s, d)), *SHARE),
    "dom89_view_dates": lambda s, d: facts(s, d).groupBy("entity", "period").agg(F.min("available_at").alias("first_on"), F.max("available_at").alias("last_on"), F.max("revision").alias("n_revisions")),
}

FACTS = """
fact AS (SELECT o_custkey AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, CAST(row_number() OVER w - 1 AS INTEGER) AS revision, CAST(o_orderdate AS DATE) AS available_at,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) + 3e-5, 2) AS value FROM orders
  WINDOW w AS (PARTITION BY o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) ORDER BY o_orderdate, o_orderkey)),
last AS (SELECT entity, period, arg_max(value, revision) AS value FROM fact GROUP BY 1, 2)
"""
_AGO = "LEFT JOIN last {a} ON {a}.entity = l.entity AND {a}.period = l.period - INTERVAL {m} MONTH"
_PCT = "CASE WHEN {b} > 0 THEN ({a} / {b} - 1.0) * 100.0 END"

_QUARTERS = """WITH o AS (SELECT o_custkey AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, o_totalprice, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders),
f AS (SELECT entity, CAST(period + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, row_number() OVER w - 1 AS revision, day AS available_at, round(sum(o_totalprice) OVER w + 3e-5, 2) AS value FROM o WINDOW w AS (PARTITION BY entity, period ORDER BY day, o_orderkey)),
sn AS (SELECT *, 'STANDALONE' AS basis FROM f UNION ALL SELECT * REPLACE (value * 1.25 AS value), 'CONSOLIDATED' FROM f WHERE entity % 3 = 2 OR (entity % 3 = 1 AND period_end < DATE '1997-01-01')),
us AS (SELECT * FROM sn WHERE available_at <= DATE '1998-06-30' AND (entity + revision) % 11 <> 5 QUALIFY row_number() OVER (PARTITION BY entity, period_end, basis ORDER BY revision DESC) = 1),
ne AS (SELECT entity, max(period_end) AS newest FROM us GROUP BY entity), wh AS (SELECT ne.entity, CASE WHEN bool_or(basis = 'CONSOLIDATED' AND period_end = newest) THEN 'CONSOLIDATED' ELSE 'STANDALONE' END AS wanted FROM us JOIN ne USING (entity) GROUP BY ne.entity),
mi AS (SELECT us.*, row_number() OVER w AS age, first_value(available_at) OVER w AS latest_at FROM us JOIN wh ON wh.entity = us.entity AND basis = wanted WINDOW w AS (PARTITION BY us.entity ORDER BY period_end DESC)),
sc AS (SELECT *, value * 0.001 AS filed, value * 0.001 * CASE WHEN entity % 4 = 0 AND available_at < DATE '1996-07-01' AND latest_at >= DATE '1996-07-01' THEN 0.5 ELSE 1.0 END * CASE WHEN entity % 6 = 0 AND available_at < DATE '1997-04-01' AND latest_at >= DATE '1997-04-01' THEN 0.5 ELSE 1.0 END AS eps FROM mi),
hi AS (SELECT a.entity, a.period_end, a.basis, a.revision, a.available_at, a.value AS revenue, a.eps, a.filed AS eps_as_filed, CASE WHEN a.entity % 5 <> 0 THEN (a.value * 0.15 + a.value * 0.01 + a.value * 0.02 - a.value * 0.005) / a.value * 100 END AS operating_margin, a.value * 0.1 / a.value * 100 AS net_margin,
  (a.eps / b.eps - 1) * 100 AS eps_yoy, CASE WHEN b.entity IS NOT NULL THEN 'AVAILABLE' WHEN EXISTS (SELECT 1 FROM us x WHERE x.entity = a.entity AND x.basis <> a.basis AND x.period_end = last_day(CAST(a.period_end - INTERVAL 12 MONTH AS DATE))) THEN 'BASIS_CHANGE' ELSE 'MISSING' END AS eps_yoy_state, (a.value / b.value - 1) * 100 AS sales_yoy, a.age
  FROM sc a LEFT JOIN sc b ON b.entity = a.entity AND b.period_end = last_day(CAST(a.period_end - INTERVAL 12 MONTH AS DATE)) WHERE a.age <= 12),
vi AS (SELECT *, CASE WHEN lag(age) OVER w = age + 1 THEN eps_yoy - lag(eps_yoy) OVER w END AS eps_acceleration, date_diff('day', available_at, DATE '1998-06-30') > 120 AS stale FROM hi WINDOW w AS (PARTITION BY entity ORDER BY period_end))
"""
_ROW = "entity, period_end, basis, revision, available_at, " + ", ".join(f"round({c} + 3e-10, 6) AS {c}" for c in VALUES) + ", eps_yoy_state, eps_yoy_state AS sales_yoy_state"

ORACLES = {
    "dom88_quarter_history": _QUARTERS + f"SELECT {_ROW}, age FROM hi",
    "dom87_current_views": _QUARTERS + f"SELECT {_ROW}, round(eps_acceleration + 3e-10, 6) AS eps_acceleration, stale FROM vi WHERE age = 1",
    "fil08_fundamentals_screen": _QUARTERS + f"SELECT {_ROW}, round(eps_acceleration + 3e-10, 6) AS eps_acceleration, stale FROM vi WHERE age = 1 AND eps_yoy >= 0 AND sales_yoy >= -50 AND eps_acceleration > 0 AND NOT stale",
    "dom85_facts": "WITH " + FACTS + "SELECT * FROM fact",
    "dom86_usable": "WITH " + FACTS + "SELECT entity, period, max(revision) AS revision, arg_max(available_at, revision) AS available_at, arg_max(value, revision) AS value FROM fact WHERE available_at <= DATE '1997-02-10' GROUP BY 1, 2",
    "dom85_quarters": "WITH " + FACTS + """, y AS (SELECT entity, period, round(sum(value) OVER (PARTITION BY entity, year(period) ORDER BY period) + 3e-5, 2) AS value FROM last),
z AS (SELECT *, lag(value) OVER w AS b, lag(period) OVER w AS p FROM y WINDOW w AS (PARTITION BY entity, year(period) ORDER BY period))
SELECT entity, period, value, round(CASE WHEN quarter(period) = 1 THEN value WHEN p + INTERVAL 3 MONTH = period THEN value - b END + 3e-10, 6) AS quarter_value FROM z""",
    "dom87_growth": "WITH " + FACTS + f"""SELECT l.entity, l.period, l.value, round({_PCT.format(a='l.value', b='a.value')} + 3e-10, 6) AS yoy, round({_PCT.format(a='l.value', b='q.value')} + 3e-10, 6) AS qoq,
  {_PCT.format(a='l.value', b='a.value')} > {_PCT.format(a='q.value', b='ap.value')} AS accelerating, round(l.value + q.value + t.value + h.value + 3e-10, 6) AS ttm
FROM last l {_AGO.format(a='a', m=12)} {_AGO.format(a='q', m=3)} {_AGO.format(a='t', m=6)} {_AGO.format(a='h', m=9)} {_AGO.format(a='ap', m=15)}""",
    "dom91_holdings": """WITH q AS (SELECT l_suppkey AS entity, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, CASE l_returnflag WHEN 'N' THEN 'A' WHEN 'A' THEN 'B' ELSE 'C' END AS part, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT entity, period, part, round(q / sum(q) OVER (PARTITION BY entity, period) * 100 + 3e-7, 4) AS pct FROM q),
w AS (SELECT entity, period, max(pct) FILTER (WHERE part = 'A') AS A, max(pct) FILTER (WHERE part = 'B') AS B, max(pct) FILTER (WHERE part = 'C') AS C FROM p GROUP BY 1, 2),
c AS (SELECT *, """ + ", ".join(f"{c} - lag({c}{', 4' if k else ''}) OVER (PARTITION BY entity ORDER BY period) AS {c}_change{k}" for c in "ABC" for k in ("", "_4")) + """, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS n FROM w)
SELECT entity, period, """ + ", ".join(f"round({c} + 3e-10, 6) AS {c}" for c in SHARE) + ", abs(coalesce(A, 0) + coalesce(B, 0) + coalesce(C, 0) - 100) < 0.5 AS sums_up FROM c WHERE n = 1",
    "dom89_view_dates": "WITH " + FACTS + "SELECT entity, period, min(available_at) AS first_on, max(available_at) AS last_on, max(revision) AS n_revisions FROM fact GROUP BY 1, 2",
}
