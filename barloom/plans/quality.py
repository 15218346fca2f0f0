"""Queries of data quality, identity, reconciliation and screens."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import r6
from barloom.operators import adjust, identity, quality
from barloom.operators.features import by_day, daily_features
from barloom.operators.trend import screened, weekly_stage
from barloom.plans.market import RAW, raw
from barloom.plans.screen import rounded
from barloom.plans.sql import BARS, FEATURES, STAGE, STRENGTH, TREND, WEEKLY, with_
from barloom.plans.temporal import ACTIONS
from barloom.sources.bars import actions, model_bars, sectors, sessions, table


def absent(s, d):
    b = model_bars(s, d)
    return quality.absences(b, sessions(b))


def blocked(s, d):
    unadjusted, acts = raw(s, d)
    jumps = adjust.gaps(unadjusted, acts.where("instrument % 3 <> 0"))
    return quality.gate(model_bars(s, d), jumps.where("blocks"))


def crosscheck(s, d):
    """The model bars against a copy with a spike on every 97th bar and a lasting step on every 311th."""
    b = model_bars(s, d).withColumn("n", F.row_number().over(by_day()))
    steps = F.sum(F.when(F.col("n") % 311 == 0, 1).otherwise(0)).over(by_day())
    other = b.select("instrument", "trade_date", (F.col("close") * F.pow(F.lit(1.1), steps) * F.when(F.col("n") % 97 == 0, 1.2).otherwise(1.0)).alias("close")).where("n % 5 <> 0")
    return rounded(quality.crosscheck(b, other), "step")


def feeds(s, d):
    a = actions(model_bars(s, d)).select("instrument", F.when(F.col("instrument") % 2 == 0, "SPLIT").otherwise("BONUS").alias("kind"), "ex_date", "num", "den")
    k = F.datediff("ex_date", F.lit("1990-01-01").cast("date")) % 10
    second = a.where(k != 3).select("instrument", "kind", "ex_date", F.when(k == 4, F.col("num") + 1).otherwise(F.col("num") * 2).alias("num"), F.when(k == 4, F.col("den")).otherwise(F.col("den") * 2).alias("den"))
    return quality.reconcile(a.where(k != 5), second, a.where(k == 6), "1998-06-30", 400)


def codes(s, d):
    """Orders as days of identifier codes: a customer's code changes with the year, its symbol stays."""
    o = table(s, d, "orders")
    return o.select(F.format_string("ISS%06d-%d", F.col("o_custkey"), (F.year("o_orderdate") / 2).cast("int")).alias("code"), F.format_string("SYM%d", "o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day")).distinct()


def identities(s, d):
    days = codes(s, d)
    ids = identity.resolve(identity.identifier_links(days, issuer=F.substring_index("code", "-", 1)))
    named = days.join(ids, "code", "left").select(F.coalesce("id", "code").alias("id"), "code", "day")
    return identity.periods(named.distinct())


def final_bars(s, d):
    """Provisional closes of the model bars superseded by final ones of trade: counts per action and source."""
    now = model_bars(s, d).select("instrument", "trade_date", F.round("close", 1).alias("close"), F.when(F.col("instrument") % 2 == 0, "A").otherwise("B").alias("source"))
    final = model_bars(s, d).where("instrument % 5 <> 0").select("instrument", "trade_date", F.round(F.when(F.col("instrument") % 3 == 0, F.col("close") + 1).otherwise(F.col("close")), 1).alias("final"))
    both = now.join(final, ["instrument", "trade_date"], "full")
    act = F.when(F.col("final").isNull(), "KEPT").when(F.col("close").isNull(), "NEW").when(F.col("close") == F.col("final"), "SAME").otherwise("SUPERSEDED")
    return both.groupBy(act.alias("action"), "source").agg(F.count("*").alias("n"))


def version_label(s, d):
    """A label of an instrument's factors: a hash of their ordered text."""
    a = actions(model_bars(s, d)).withColumn("t", F.concat_ws(":", F.col("ex_date").cast("string"), "num", "den"))
    return a.groupBy("instrument").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("t"))), 256).alias("version"), F.count("*").alias("n"))


def watch_list(s, d):
    """Bars within five percent below their level of 50 bars: the nearest of each instrument's last ten bars."""
    f = daily_features(model_bars(s, d)).select("instrument", "trade_date", "close", F.col("high_50").alias("level"), "volume_avg_50")
    recent = f.withColumn("k", F.row_number().over(W.partitionBy("instrument").orderBy(F.desc("trade_date")))).where("k <= 10 AND level IS NOT NULL")
    near = recent.withColumn("below", (F.col("level") / F.col("close") - 1) * 100).where("below BETWEEN 0 AND 5")
    best = near.withColumn("r", F.row_number().over(W.partitionBy("instrument").orderBy("below", F.desc("trade_date")))).where("r = 1")
    return rounded(best.select("instrument", "trade_date", "close", "level", "below", "volume_avg_50"), "below", "volume_avg_50")


def screener(s, d, min_rank: int = 60, stages: tuple[str, ...] = ("STAGE_2", "TRANSITION"), near_high: float = 15.0):
    """The screen of one day with all its predicates; filters are columns, so Catalyst pushes what it can."""
    b = model_bars(s, d)
    rows = screened(b).select("instrument", "trade_date", "close", "high_252", "rs_rank", "n_passed", "status").join(weekly_stage(b).select("instrument", "trade_date", "stage"), ["instrument", "trade_date"]).join(sectors(s, d), "instrument", "left")
    test = (F.col("rs_rank") >= min_rank) & F.col("stage").isin(*stages) & (F.col("close") >= F.col("high_252") * (1 - near_high / 100)) & (F.col("n_passed") >= 6)
    return rows.where(test).select("instrument", "trade_date", "close", "rs_rank", "n_passed", "status", "stage", "sector")


def listings(s, d):
    """Instruments by their first half year: first close, best and last return, days."""
    b = model_bars(s, d).withColumn("n", F.row_number().over(by_day()))
    return b.where("n <= 126").groupBy("instrument").agg(F.min("trade_date").alias("listed"), F.min_by("close", "trade_date").alias("first_close"), r6((F.max("high") / F.min_by("close", "trade_date") - 1) * 100).alias("best_pct"), r6((F.max_by("close", "trade_date") / F.min_by("close", "trade_date") - 1) * 100).alias("last_pct"))


def digest(s, d):
    """Weekly numbers of the equal-weight market: first and last share above the 50-bar mean, change, passes."""
    f = screened(model_bars(s, d))
    day = f.groupBy("trade_date").agg(F.avg(F.when(F.col("sma_50").isNotNull(), F.when(F.col("close") > F.col("sma_50"), 100.0).otherwise(0.0))).alias("share"), F.avg("daily_return").alias("r"), F.count(F.when(F.col("status") == "PASS", 1)).alias("n_pass"))
    return day.groupBy(F.date_trunc("week", "trade_date").cast("date").alias("week")).agg(r6(F.min_by("share", "trade_date")).alias("first_share"), r6(F.max_by("share", "trade_date")).alias("last_share"), r6((F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0))))) - 1) * 100).alias("change_pct"), F.sum("n_pass").alias("n_pass"), F.count("*").alias("n_days"))


QUERIES = {
    "dom10_absences": absent,
    "dom11_observed_sessions": lambda s, d: quality.observed_sessions(model_bars(s, d)),
    "dom12_completeness": lambda s, d: quality.completeness(model_bars(s, d), sessions(model_bars(s, d)), 0.21),
    "dom16_gate": blocked,
    "dom17_crosscheck": crosscheck,
    "dom01_reconcile": feeds,
    "dom03_rights_factor": lambda s, d: rounded(model_bars(s, d).select("instrument", "trade_date", F.lag("close").over(by_day()).alias("prior")).where("prior IS NOT NULL").select("instrument", "trade_date", quality.rights_factor(F.col("prior"), F.lit(1.0), F.lit(4.0), F.lit(60.0)).alias("factor")), "factor"),
    "dom19_triage": lambda s, d: rounded(quality.triage(adjust.gaps(*raw(s, d)).select("instrument", "trade_date", "hint"), model_bars(s, d)), "volume_before", "volume_after", "level_later"),
    "dom52_volume_scores": lambda s, d: rounded(quality.volume_scores(model_bars(s, d)), "up_down"),
    "bt04_final_bars": final_bars,
    "bt09_identity": identities,
    "bt18_version_label": version_label,
    "dom102_watch_list": watch_list,
    "fil07_screener": screener,
    "dom92_listings": listings,
    "dom83_digest": digest,
    "win19_last_change": lambda s, d: model_bars(s, d).select("instrument", "trade_date", "close", F.lag("close").over(by_day()).alias("before"), F.row_number().over(W.partitionBy("instrument").orderBy(F.desc("trade_date"))).alias("k")).where("k = 1").select("instrument", "trade_date", r6((F.col("close") / F.col("before") - 1) * 100).alias("change_pct")),
    "win17_rolling_label": lambda s, d: model_bars(s, d).withColumn("down", F.when((F.col("close") < F.col("open") * 0.998) & (F.col("volume") > F.lag("volume").over(by_day())), 1).otherwise(0)).select("instrument", "trade_date", F.sum("down").over(by_day().rowsBetween(-24, 0)).alias("n_down")),
    "scl02_hashes": lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderpriority")))), 256).alias("results_hash")),
    "scl06_arrays": lambda s, d: model_bars(s, d).groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("trade_date", "close"))).alias("b")).select("instrument", F.size("b").alias("n"), F.size(F.filter(F.zip_with(F.slice("b", 2, F.size("b")), F.col("b"), lambda a, b: a["close"] > b["close"]), lambda x: x)).alias("n_up")),
}

ORACLES = {
    "dom10_absences": with_(BARS) + """, s AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session FROM (SELECT DISTINCT trade_date FROM bars)), h AS (SELECT instrument, trade_date, session, lag(session) OVER w AS p, lag(trade_date) OVER w AS last_traded FROM bars JOIN s USING (trade_date) WINDOW w AS (PARTITION BY instrument ORDER BY trade_date))
SELECT instrument, last_traded, trade_date AS resumed, session - p - 1 AS missed FROM h WHERE session - p - 1 >= 20""",
    "dom11_observed_sessions": with_(BARS) + """, p AS (SELECT instrument, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY 1), d AS (SELECT trade_date, count(*) AS present FROM bars GROUP BY 1),
c AS (SELECT *, (SELECT count(*) FROM p WHERE a <= trade_date AND trade_date <= b) AS active FROM d) SELECT *, present / CAST(active AS DOUBLE) >= 0.1 AS is_session FROM c""",
    "dom12_completeness": with_(BARS) + """, s AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session FROM (SELECT DISTINCT trade_date FROM bars)), h AS (SELECT instrument, session FROM bars JOIN s USING (trade_date)),
g AS (SELECT instrument, session - lag(session) OVER (PARTITION BY instrument ORDER BY session) - 1 AS gap FROM h), r AS (SELECT instrument, count(*) AS runs, max(gap) AS longest FROM g WHERE gap > 0 GROUP BY 1),
p AS (SELECT instrument, max(session) - min(session) + 1 AS expected, count(*) AS present FROM h GROUP BY 1)
SELECT p.*, coalesce(runs, 0) AS runs, coalesce(longest, 0) AS longest, CASE WHEN present / CAST(expected AS DOUBLE) < 0.21 THEN 'UNVERIFIED' WHEN runs IS NULL THEN 'COMPLETE' ELSE 'GAPS' END AS verdict FROM p LEFT JOIN r USING (instrument)""",
    "dom16_gate": with_(BARS, ACTIONS, RAW) + """, t AS (SELECT instrument, trade_date, open / lag(close) OVER w AS jump, lag(trade_date) OVER w AS pd FROM traded WINDOW w AS (PARTITION BY instrument ORDER BY trade_date)),
j AS (SELECT * FROM t WHERE abs(jump - 1) >= 0.3), x AS (SELECT j.instrument, j.trade_date, exp(sum(ln(a.factor))) AS e FROM j JOIN act a ON a.instrument = j.instrument AND a.instrument % 3 <> 0 AND a.ex_date > pd AND a.ex_date <= j.trade_date GROUP BY 1, 2),
k AS (SELECT j.instrument, j.trade_date FROM j LEFT JOIN x USING (instrument, trade_date) WHERE jump / coalesce(e, 1.0) <= 0.7),
n AS (SELECT b.instrument, b.trade_date, row_number() OVER (PARTITION BY b.instrument ORDER BY b.trade_date) AS n, k.instrument IS NOT NULL AS hit FROM bars b LEFT JOIN k USING (instrument, trade_date))
SELECT instrument, trade_date, coalesce(n - max(CASE WHEN hit THEN n END) OVER (PARTITION BY instrument ORDER BY trade_date) < 253, false) AS blocked FROM n""",
    "dom17_crosscheck": with_(BARS) + """, b AS (SELECT instrument, trade_date, close, row_number() OVER (PARTITION BY instrument ORDER BY trade_date) AS n FROM bars),
o AS (SELECT *, sum(CASE WHEN n % 311 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY trade_date) AS st FROM b),
q AS (SELECT instrument, trade_date, ln(close) - ln(close * pow(1.1, st) * CASE WHEN n % 97 = 0 THEN 1.2 ELSE 1.0 END) AS r FROM o WHERE n % 5 <> 0),
s AS (SELECT *, r - lag(r) OVER (PARTITION BY instrument ORDER BY trade_date) AS step FROM q),
f AS (SELECT *, coalesce(abs(step) > 0.01, false) AS big, lead(step) OVER w AS nx, lag(step) OVER w AS pv FROM s WINDOW w AS (PARTITION BY instrument ORDER BY trade_date))
SELECT instrument, trade_date, round(step + 3e-10, 6) AS step, CASE WHEN abs(step + nx) <= 0.01 THEN 'REVERSING' ELSE 'LEVEL' END AS kind FROM f WHERE big AND NOT coalesce(abs(pv) > 0.01 AND abs(step + pv) <= 0.01, false)""",
    "dom01_reconcile": with_(BARS, ACTIONS) + """, a AS (SELECT instrument, CASE WHEN instrument % 2 = 0 THEN 'SPLIT' ELSE 'BONUS' END AS kind, ex_date, num, den, (ex_date - DATE '1990-01-01') % 10 AS k FROM act)
SELECT instrument, kind, ex_date, CASE WHEN k = 6 THEN 'MANUAL' WHEN k = 3 THEN CASE WHEN DATE '1998-06-30' - ex_date > 400 THEN 'CONFLICT' ELSE 'PENDING' END WHEN k = 5 THEN 'CONFLICT' WHEN k = 4 THEN CASE WHEN num * den = (num + 1) * den THEN 'CONFIRMED' ELSE 'CONFLICT' END ELSE 'CONFIRMED' END AS state,
  CASE WHEN k = 6 THEN NULL WHEN k = 4 THEN 'RATIO' WHEN k = 3 AND DATE '1998-06-30' - ex_date > 400 THEN 'SECOND_MISSING' WHEN k = 5 THEN 'FIRST_MISSING' END AS differs,
  CASE WHEN k = 5 THEN num * 2 ELSE num END AS num, CASE WHEN k = 5 THEN den * 2 ELSE den END AS den FROM a""",
    "dom03_rights_factor": with_(BARS) + """, p AS (SELECT instrument, trade_date, lag(close) OVER (PARTITION BY instrument ORDER BY trade_date) AS prior FROM bars), f AS (SELECT *, (4.0 * prior + 1.0 * 60.0) / ((1.0 + 4.0) * prior) AS f FROM p WHERE prior IS NOT NULL)
SELECT instrument, trade_date, round(CASE WHEN prior > 0 AND f < 1 AND f > 0.02 THEN f END + 3e-10, 6) AS factor FROM f""",
    "dom19_triage": with_(BARS, ACTIONS, RAW) + """, t AS (SELECT instrument, trade_date, open / lag(close) OVER (PARTITION BY instrument ORDER BY trade_date) AS jump FROM traded),
v AS (SELECT instrument, trade_date, median(volume) OVER p AS vb, median(volume) OVER a AS va, lead(close, 20) OVER w / lag(close) OVER w AS lv FROM bars
  WINDOW w AS (PARTITION BY instrument ORDER BY trade_date), p AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
SELECT t.instrument, t.trade_date, (SELECT arg_min(h.ratio, (abs(t.jump - h.v), h.ratio)) FROM (VALUES ('1:2', 1 / 2.0), ('2:3', 2 / CAST(3 AS DOUBLE)), ('1:3', 1 / CAST(3 AS DOUBLE)), ('3:4', 0.75), ('1:4', 0.25), ('1:5', 0.2), ('1:10', 0.1)) AS h(ratio, v)) AS hint,
  round(vb + 3e-10, 6) AS volume_before, round(va + 3e-10, 6) AS volume_after, round(lv + 3e-10, 6) AS level_later FROM t JOIN v USING (instrument, trade_date) WHERE abs(jump - 1) >= 0.3""",
    "dom52_volume_scores": with_(BARS) + """, c AS (SELECT instrument, trade_date, close, volume, lag(close) OVER w AS pc, avg(volume) OVER p AS base, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY trade_date), p AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
x AS (SELECT instrument, trade_date, n, sum(CASE WHEN close > pc THEN volume ELSE 0 END) OVER a AS u, sum(CASE WHEN close < pc THEN volume ELSE 0 END) OVER a AS dn, min(volume) OVER a AS mv, sum(CASE WHEN close < pc AND volume > 1.1 * base THEN 1 ELSE 0 END) OVER b AS h FROM c
  WINDOW a AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))
SELECT instrument, trade_date, round(CASE WHEN n > 50 AND mv > 0 THEN CASE WHEN dn > 0 THEN u / dn WHEN u > 0 THEN 10.0 END END + 3e-10, 6) AS up_down, CAST(CASE WHEN n >= 76 THEN h END AS BIGINT) AS distribution_days FROM x""",
    "bt04_final_bars": with_(BARS) + """, f AS (SELECT instrument, trade_date, round(close, 1) AS c, CASE WHEN instrument % 5 <> 0 THEN round(CASE WHEN instrument % 3 = 0 THEN close + 1 ELSE close END, 1) END AS f FROM bars)
SELECT CASE WHEN f IS NULL THEN 'KEPT' WHEN c = f THEN 'SAME' ELSE 'SUPERSEDED' END AS action, CASE WHEN instrument % 2 = 0 THEN 'A' ELSE 'B' END AS source, count(*) AS n FROM f GROUP BY 1, 2""",
    "bt09_identity": """WITH c AS (SELECT DISTINCT o_custkey AS k, CAST(floor(year(o_orderdate) / 2) AS INTEGER) AS y, CAST(o_orderdate AS DATE) AS day FROM orders),
p AS (SELECT k, y, min(day) AS valid_from FROM c GROUP BY 1, 2), q AS (SELECT *, lead(valid_from) OVER w AS valid_to, lag(y) OVER w AS before, first_value(y) OVER w AS first FROM p WINDOW w AS (PARTITION BY k ORDER BY y))
SELECT 'ISS' || lpad(CAST(k AS VARCHAR), 6, '0') || '-' || first AS id, 'ISS' || lpad(CAST(k AS VARCHAR), 6, '0') || '-' || y AS code, valid_from, valid_to, CASE WHEN before IS NULL THEN 'FIRST' ELSE 'CODE_CHANGE' END AS reason FROM q""",
    "bt18_version_label": with_(BARS, ACTIONS) + "SELECT instrument, sha256(string_agg(CAST(ex_date AS VARCHAR) || ':' || num || ':' || den, '|' ORDER BY ex_date)) AS version, count(*) AS n FROM act GROUP BY 1",
    "dom102_watch_list": with_(BARS, FEATURES) + """, k AS (SELECT instrument, trade_date, close, high_50 AS level, volume_avg_50, row_number() OVER (PARTITION BY instrument ORDER BY trade_date DESC) AS k FROM feat),
n AS (SELECT *, (level / close - 1) * 100 AS below FROM k WHERE k <= 10 AND level IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY below, trade_date DESC) AS r FROM n WHERE below BETWEEN 0 AND 5)
SELECT instrument, trade_date, close, level, round(below + 3e-10, 6) AS below, round(volume_avg_50 + 3e-10, 6) AS volume_avg_50 FROM r WHERE r = 1""",
    "fil07_screener": with_(BARS, FEATURES, STRENGTH, TREND, WEEKLY, STAGE) + """SELECT s.instrument, s.trade_date, s.close, s.rs_rank, s.n_passed, s.status, g.stage, n_name AS sector FROM status s JOIN feat f USING (instrument, trade_date) JOIN stage g USING (instrument, trade_date)
LEFT JOIN supplier ON s_suppkey = s.instrument LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s.rs_rank >= 60 AND g.stage IN ('STAGE_2', 'TRANSITION') AND s.close >= f.high_252 * 0.85 AND s.n_passed >= 6""",
    "dom92_listings": with_(BARS) + """, n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY trade_date) AS n FROM bars)
SELECT instrument, min(trade_date) AS listed, arg_min(close, trade_date) AS first_close, round((max(high) / arg_min(close, trade_date) - 1) * 100 + 3e-10, 6) AS best_pct, round((arg_max(close, trade_date) / arg_min(close, trade_date) - 1) * 100 + 3e-10, 6) AS last_pct FROM n WHERE n <= 126 GROUP BY 1""",
    "dom83_digest": with_(BARS, FEATURES, STRENGTH, TREND) + """, d AS (SELECT trade_date, avg(CASE WHEN sma_50 IS NOT NULL THEN CASE WHEN f.close > sma_50 THEN 100.0 ELSE 0.0 END END) AS share, avg(daily_return) AS r, count(*) FILTER (WHERE status = 'PASS') AS n_pass FROM feat f JOIN status s USING (instrument, trade_date) GROUP BY 1)
SELECT CAST(date_trunc('week', trade_date) AS DATE) AS week, round(arg_min_null(share, trade_date) + 3e-10, 6) AS first_share, round(arg_max_null(share, trade_date) + 3e-10, 6) AS last_share, round((exp(sum(ln(1 + coalesce(r, 0)))) - 1) * 100 + 3e-10, 6) AS change_pct, CAST(sum(n_pass) AS BIGINT) AS n_pass, count(*) AS n_days FROM d GROUP BY 1""",
    "win19_last_change": with_(BARS) + ", k AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY trade_date) AS p, row_number() OVER (PARTITION BY instrument ORDER BY trade_date DESC) AS k FROM bars) SELECT instrument, trade_date, round((close / p - 1) * 100 + 3e-10, 6) AS change_pct FROM k WHERE k = 1",
    "win17_rolling_label": with_(BARS) + ", d AS (SELECT *, CASE WHEN close < open * 0.998 AND volume > lag(volume) OVER (PARTITION BY instrument ORDER BY trade_date) THEN 1 ELSE 0 END AS down FROM bars) SELECT instrument, trade_date, CAST(sum(down) OVER (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_down FROM d",
    "scl02_hashes": "SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderpriority, '|' ORDER BY o_orderkey || ':' || o_orderpriority)) AS results_hash FROM orders GROUP BY 1",
    "scl06_arrays": with_(BARS) + ", u AS (SELECT instrument, close > lag(close) OVER (PARTITION BY instrument ORDER BY trade_date) AS up FROM bars) SELECT instrument, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE up) AS INTEGER) AS n_up FROM u GROUP BY 1",
}
