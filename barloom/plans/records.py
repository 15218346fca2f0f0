"""Queries of lists over time, run records, factors around ex-dates and the flow of setups."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import streaming as st
from barloom.functions import r6
from barloom.operators import adjust, events, flow, market, records
from barloom.operators.trend import trend_status
from barloom.plans.market import ALL, RAW, pan, raw
from barloom.plans.screen import rounded
from barloom.plans.sql import BARS, FEATURES, STRENGTH, TREND, with_
from barloom.plans.temporal import ACTIONS
from barloom.sources import store
from barloom.sources.bars import actions, model_bars, sessions


def daily_lists(s, d):
    """Who is on a surveillance list of a day, by instrument and month; no list was fetched on the 3rd, 13th and 23rd."""
    bars = model_bars(s, d)
    stage = (F.col("instrument") * 7 + F.year("trade_date") * 12 + F.month("trade_date")) % 3
    lists = bars.where(stage > 0).select(F.col("trade_date").alias("day"), "instrument", F.concat(F.lit("STAGE_"), stage.cast("string")).alias("flag"))
    return lists, bars.where(F.dayofmonth("trade_date") % 10 != 3).select(F.col("trade_date").alias("day"))


def scans(s, d):
    """Trend verdicts by month, as they were kept and as they are rebuilt: in every fifth month one instrument in seven has another verdict, and 1998-01 is not rebuilt."""
    rows = trend_status(model_bars(s, d)).select("instrument", "trade_date", "status", "n_passed", F.date_format("trade_date", "yyyy-MM").alias("month"))
    off = (F.col("instrument") % 7 == 0) & (F.month("trade_date") % 5 == 0)
    return rows, rows.where("month <> '1998-01'").withColumn("status", F.when(off, "OTHER").otherwise(F.col("status")))


def kept_runs(s, d):
    rows, _ = scans(s, d)
    read = model_bars(s, d).select("instrument", "trade_date", (F.col("close") * 10_000).cast("decimal(20,0)").alias("close"), F.date_format("trade_date", "yyyy-MM").alias("month"))
    return records.run_records(rows, "month", "screen-1", read)


def verified(s, d):
    rows, rebuilt = scans(s, d)
    return records.verify_runs(kept_runs(s, d), rows, rebuilt, "month")


def day_actions(s, d):
    """Splits of the given actions, some with a wrong ratio or a day late, beside rights, demergers and unmodelled readings of the same day."""
    a = actions(model_bars(s, d))
    i = F.col("instrument")
    late = F.when(i % 6 == 5, F.date_add("ex_date", 1)).otherwise(F.col("ex_date"))
    base = a.select("instrument", late.alias("ex_date"), F.when(i % 10 == 9, F.col("num") * 10).otherwise(F.col("num")).cast("double").alias("num"), F.col("den").cast("double").alias("den"))
    row = lambda kind, num, den, price, test: base.where(test).select("instrument", "ex_date", F.lit(kind).alias("kind"), num.cast("double").alias("num"), den.cast("double").alias("den"), F.lit(price).cast("double").alias("price"))
    none = F.lit(None)
    return row("SPLIT", F.col("num"), F.col("den"), None, F.lit(True)).unionByName(row("RIGHTS", F.lit(1), F.lit(4), 40.0, i % 4 == 1)).unionByName(row("DEMERGER", none, none, None, i % 4 == 2)).unionByName(row("UNMODELLED", none, none, None, i % 8 == 3))


def provided(s, d):
    """What traded; one instrument in ten comes from a vendor."""
    return raw(s, d)[0].withColumn("provider", F.when(F.col("instrument") % 10 == 7, "VENDOR").otherwise("EXCHANGE"))


def priced(s, d):
    return adjust.ex_prices(provided(s, d), day_actions(s, d))


def verdicts(s, d):
    """Whether a provider's bars contain the actions: adjusted ones for even instruments, what traded for the others."""
    traded, acts = raw(s, d)
    bars = model_bars(s, d).where("instrument % 2 = 0").select("instrument", "trade_date", "open", "close").unionByName(traded.where("instrument % 2 = 1").select("instrument", "trade_date", "open", "close"))
    at = adjust.ex_prices(bars.withColumn("provider", F.lit("EXCHANGE")), acts.select("instrument", "ex_date", "factor")).withColumnRenamed("ex_open", "next_open")
    return adjust.provider_verdict(at)


def setup_flow(s, d):
    """Setups and breakouts are all among the passing bars, which are kept, so that bars are screened once."""
    at, bars = st.scratch(s), model_bars(s, d)
    with store.released(s):
        market.passing(pan(s, d)).write.parquet(f"{at}/passing")
        sessions(bars).write.parquet(f"{at}/sessions")
    passing = s.read.parquet(f"{at}/passing")
    events = market.breakouts(passing).select("instrument", F.col("trade_date").alias("day"), "level")
    setups = passing.where("eligible").select("instrument", F.col("trade_date").alias("day"))
    return flow.setup_flow(setups, events, bars, s.read.parquet(f"{at}/sessions"))


def quality_events(s, d):
    """Events of the actions, of which one instrument in thirteen has sources that disagree and one was entered by hand, and of codes that change each other year."""
    i = F.col("instrument") % 13
    readings = adjust.day_factors(priced(s, d)).withColumn("status", F.when(i == 0, "PROVIDER_CONFLICT").when(i == 1, "MANUAL_OVERRIDE").otherwise("CONFIRMED"))
    bars = model_bars(s, d)
    codes = bars.select("instrument", "trade_date", F.concat_ws("-", F.col("instrument").cast("string"), F.floor(F.year("trade_date") / 2).cast("string")).alias("code"))
    return events.action_events(readings), events.identity_events(codes, actions(bars))


def all_events(s, d):
    first, second = quality_events(s, d)
    return first.unionByName(second)


QUERIES = {
    "dom14_action_events": lambda s, d: quality_events(s, d)[0],
    "dom15_identity_events": lambda s, d: quality_events(s, d)[1],
    "fil11_event_counts": lambda s, d: events.event_counts(all_events(s, d)),
    "fil11_event_page": lambda s, d: events.event_page(all_events(s, d), 200, severity="critical"),
    "src09_validity": lambda s, d: records.validity(*daily_lists(s, d)),
    "dom25_run_records": lambda s, d: kept_runs(s, d),
    "dom25_verified": verified,
    "dom04_ex_prices": lambda s, d: rounded(priced(s, d), "prior_close", "ex_open"),
    "dom05_day_factors": lambda s, d: adjust.day_factors(priced(s, d)).select("instrument", "ex_date", "kind", "state", r6(F.col("price_factor")).alias("price_factor"), r6(F.col("volume_factor")).alias("volume_factor")),
    "dom18_provider_verdicts": lambda s, d: rounded(verdicts(s, d), "factor", "observed"),
    "dom77_setup_flow": lambda s, d: rounded(setup_flow(s, d), "failed_pct"),
}

_SCANS = with_(BARS, FEATURES, STRENGTH, TREND) + """, st AS (SELECT strftime(trade_date, '%Y-%m') AS month, instrument, trade_date, status, n_passed FROM status),
hs AS (SELECT month, ('0x' || substr(sha256(instrument || '|' || n_passed || '|' || status || '|' || trade_date), 1, 12))::BIGINT AS h FROM st),
dgr AS (SELECT month, count(*) AS n_rows, sum(CAST(h AS HUGEINT)) || '-' || sum((h * (h % 8191)) % 2147483647) AS results_digest FROM hs GROUP BY month),
hi AS (SELECT strftime(trade_date, '%Y-%m') AS month, ('0x' || substr(sha256(CAST(close * 10000 AS DECIMAL(20, 0)) || '|' || instrument || '|' || trade_date), 1, 12))::BIGINT AS h FROM bars),
dgi AS (SELECT month, sum(CAST(h AS HUGEINT)) || '-' || sum((h * (h % 8191)) % 2147483647) AS inputs_digest FROM hi GROUP BY month),
rr AS (SELECT month, 'run-' || substr(sha256('screen-1|' || month || '|' || inputs_digest), 1, 20) AS run_id, 'screen-1' AS version, inputs_digest, n_rows, results_digest FROM dgr JOIN dgi USING (month))
"""
_PRICED = with_(BARS, ACTIONS, RAW) + """, base AS (SELECT instrument, CASE WHEN instrument % 6 = 5 THEN ex_date + 1 ELSE ex_date END AS ex_date, CAST(CASE WHEN instrument % 10 = 9 THEN num * 10 ELSE num END AS DOUBLE) AS num, CAST(den AS DOUBLE) AS den FROM act),
da AS (SELECT instrument, ex_date, 'SPLIT' AS kind, num, den, CAST(NULL AS DOUBLE) AS price FROM base UNION ALL SELECT instrument, ex_date, 'RIGHTS', 1.0, 4.0, 40.0 FROM base WHERE instrument % 4 = 1
  UNION ALL SELECT instrument, ex_date, 'DEMERGER', NULL, NULL, NULL FROM base WHERE instrument % 4 = 2 UNION ALL SELECT instrument, ex_date, 'UNMODELLED', NULL, NULL, NULL FROM base WHERE instrument % 8 = 3),
px AS (SELECT da.*, t.close AS prior_close, CASE WHEN t.close IS NOT NULL THEN o.open END AS ex_open, CASE WHEN t.close IS NOT NULL THEN da.instrument % 10 <> 7 END AS raw
  FROM da ASOF LEFT JOIN traded t ON t.instrument = da.instrument AND da.ex_date > t.trade_date LEFT JOIN traded o ON o.instrument = da.instrument AND o.trade_date = da.ex_date)
"""

_FACTORS = _PRICED + """, a AS (SELECT *, CASE WHEN kind = 'SPLIT' THEN den / num END AS ratio, bool_or(kind = 'UNMODELLED') OVER (PARTITION BY instrument, ex_date) AS odd FROM px),
b AS (SELECT *, CASE WHEN kind <> 'SPLIT' THEN NULL WHEN odd THEN 'SUPERSEDED' WHEN coalesce(raw AND prior_close > 0 AND ex_open > 0 AND (ratio <= 0.7 OR ratio >= 1 / 0.7) AND abs(ex_open / (prior_close * ratio) - 1) >= 0.3, false) THEN 'UNCONFIRMED' ELSE 'APPLIED' END AS first FROM a),
c AS (SELECT *, prior_close * exp(coalesce(sum(CASE WHEN first = 'APPLIED' THEN ln(ratio) END) OVER (PARTITION BY instrument, ex_date), 0)) AS p FROM b),
e AS (SELECT *, CASE kind WHEN 'RIGHTS' THEN CASE WHEN price >= p THEN 1.0 ELSE (den * p + num * price) / ((num + den) * p) END WHEN 'DEMERGER' THEN CASE WHEN ex_open >= p THEN CASE WHEN ex_open <= p * 1.01 THEN 1.0 END WHEN ex_open / p >= 0.02 THEN ex_open / p END END AS second FROM c),
g AS (SELECT *, CASE WHEN kind = 'SPLIT' THEN first WHEN kind = 'UNMODELLED' THEN 'UNMODELLED' WHEN NOT coalesce(raw, false) THEN 'NOT_RAW' WHEN second IS NULL THEN 'UNKNOWN' ELSE 'APPLIED' END AS state FROM e)
"""
_EVENTS = _FACTORS + """, m AS (SELECT *, instrument % 13 = 0 AS disputed, bool_or(instrument % 13 = 1) OVER (PARTITION BY instrument, ex_date) AS by_hand FROM g),
n AS (SELECT *, CASE WHEN kind = 'UNMODELLED' THEN 'UNMODELLED' WHEN odd THEN NULL WHEN state = 'UNKNOWN' AND kind = 'SPLIT' THEN 'RATIO_UNKNOWN' WHEN state = 'UNKNOWN' THEN 'FACTOR_UNKNOWN' WHEN state = 'UNCONFIRMED' AND NOT by_hand THEN 'RATIO_UNCONFIRMED' WHEN disputed THEN 'CONFLICT' END AS cause FROM m),
ae AS (SELECT 'dq-' || substr(sha256('CORPORATE_ACTION_UNRESOLVED|' || cause || '|' || instrument || '|' || kind || '|' || ex_date), 1, 20) AS event_id, instrument, ex_date AS trade_date, 'CORPORATE_ACTION_UNRESOLVED' AS event_type, cause,
  CASE WHEN cause = 'UNMODELLED' OR (cause = 'CONFLICT' AND kind <> 'SPLIT') THEN 'WARNING' ELSE 'CRITICAL' END AS severity, NOT (cause = 'UNMODELLED' OR (cause = 'CONFLICT' AND kind <> 'SPLIT')) AS blocks, kind AS note FROM n WHERE cause IS NOT NULL),
cd AS (SELECT instrument, trade_date, instrument || '-' || CAST(floor(year(trade_date) / 2) AS INTEGER) AS code FROM bars), ch AS (SELECT *, lag(code) OVER (PARTITION BY instrument ORDER BY trade_date) AS was FROM cd),
ie AS (SELECT 'dq-' || substr(sha256('IDENTITY_CHANGE|CODE_CHANGED|' || instrument || '|' || trade_date || '|' || code), 1, 20) AS event_id, instrument, trade_date, 'IDENTITY_CHANGE' AS event_type, 'CODE_CHANGED' AS cause, 'WARNING' AS severity, false AS blocks, was || ' to ' || code AS note FROM ch
  WHERE was <> code AND NOT EXISTS (SELECT 1 FROM act WHERE act.instrument = ch.instrument AND act.ex_date BETWEEN ch.trade_date - 7 AND ch.trade_date + 1)),
al AS (SELECT * FROM ae UNION ALL SELECT * FROM ie)
"""

ORACLES = {
    "dom14_action_events": _EVENTS + "SELECT * FROM ae",
    "dom15_identity_events": _EVENTS + "SELECT * FROM ie",
    "fil11_event_counts": _EVENTS + "SELECT event_type, cause, severity, count(*) AS n, count(*) FILTER (WHERE blocks) AS blocking FROM al GROUP BY ALL",
    "fil11_event_page": _EVENTS + "SELECT *, count(*) OVER () AS total FROM al WHERE severity = 'CRITICAL' ORDER BY trade_date DESC NULLS LAST, event_id LIMIT 200",
    "src09_validity": with_(BARS) + """, l AS (SELECT trade_date AS day, instrument, (instrument * 7 + year(trade_date) * 12 + month(trade_date)) % 3 AS stage FROM bars),
f AS (SELECT day, row_number() OVER (ORDER BY day) AS k, lead(day) OVER (ORDER BY day) AS following FROM (SELECT DISTINCT trade_date AS day FROM bars WHERE day(trade_date) % 10 <> 3)),
h AS (SELECT instrument, 'STAGE_' || stage AS flag, day, k, following, lag(k) OVER (PARTITION BY instrument, stage ORDER BY k) AS before FROM l JOIN f USING (day) WHERE stage > 0),
g AS (SELECT *, sum(CASE WHEN before = k - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY instrument, flag ORDER BY k) AS run FROM h)
SELECT instrument, flag, min(day) AS valid_from, nullif(max(coalesce(following, DATE '9999-12-31')), DATE '9999-12-31') AS valid_to, count(*) AS n_lists FROM g GROUP BY instrument, flag, run""",
    "dom25_run_records": _SCANS + "SELECT * FROM rr",
    "dom25_verified": _SCANS + """, x AS (SELECT month, count(*) FILTER (WHERE instrument % 7 = 0 AND month(trade_date) % 5 = 0) AS n FROM st GROUP BY month)
SELECT month, run_id, CASE WHEN month = '1998-01' THEN 'NOT_REBUILT' WHEN n > 0 THEN 'DIFFERS' ELSE 'MATCH' END AS state, CASE WHEN month = '1998-01' THEN 0 ELSE n END AS n_missing, CASE WHEN month = '1998-01' THEN 0 ELSE n END AS n_extra FROM rr JOIN x USING (month)""",
    "dom04_ex_prices": _PRICED + "SELECT instrument, ex_date, kind, num, den, price, round(prior_close + 3e-10, 6) AS prior_close, round(ex_open + 3e-10, 6) AS ex_open, raw FROM px",
    "dom05_day_factors": _FACTORS + """SELECT instrument, ex_date, kind, state, round(CASE WHEN state = 'APPLIED' THEN coalesce(ratio, second) END + 3e-10, 6) AS price_factor,
  round(CASE WHEN state = 'APPLIED' THEN CASE WHEN kind = 'DEMERGER' THEN 1.0 ELSE 1 / coalesce(ratio, second) END END + 3e-10, 6) AS volume_factor FROM g""",
    "dom18_provider_verdicts": with_(BARS, ACTIONS, RAW) + """, v AS (SELECT instrument, trade_date, open, close FROM bars WHERE instrument % 2 = 0 UNION ALL SELECT instrument, trade_date, open, close FROM traded WHERE instrument % 2 = 1),
w AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY trade_date) AS pc FROM v), x AS (SELECT act.instrument, ex_date, factor, open / pc AS observed, abs(ln(open / pc)) AS a, abs(ln(open / pc) - ln(factor)) AS r, abs(ln(factor)) / 4 AS m FROM act JOIN w ON w.instrument = act.instrument AND w.trade_date = ex_date)
SELECT instrument, ex_date, round(factor + 3e-10, 6) AS factor, round(observed + 3e-10, 6) AS observed, CASE WHEN a < m AND a < r THEN 'ADJUSTED' WHEN r < m AND r < a THEN 'RAW' ELSE 'INCONCLUSIVE' END AS verdict FROM x""",
    "dom77_setup_flow": with_(*ALL) + """, no AS (SELECT trade_date AS day, row_number() OVER (ORDER BY trade_date) AS i FROM days),
su AS (SELECT instrument, i FROM pan JOIN no ON day = trade_date WHERE status = 'PASS' AND eligible), sc AS (SELECT i, lag(i) OVER (ORDER BY i) AS b FROM (SELECT DISTINCT i FROM su)),
ne AS (SELECT sc.i, CASE WHEN sc.b IS NOT NULL THEN count(*) FILTER (WHERE was.instrument IS NULL) END AS new_setups FROM sc JOIN su ON su.i = sc.i LEFT JOIN su was ON was.instrument = su.instrument AND was.i = sc.b GROUP BY sc.i, sc.b),
bo AS (SELECT instrument, i, level FROM pan JOIN no ON day = trade_date WHERE status = 'PASS' AND level <= level_before AND close > level AND volume_before > 0 AND volume >= 1.4 * volume_before AND n_after = 10 AND i >= (SELECT min(i) FROM su)),
fa AS (SELECT bo.instrument, bo.i, min(n.i) AS fell FROM bo JOIN pan ON pan.instrument = bo.instrument JOIN no n ON n.day = pan.trade_date WHERE n.i > bo.i AND n.i <= bo.i + 5 AND pan.close < bo.level GROUP BY 1, 2),
kn AS (SELECT coalesce(fell, CASE WHEN bo.i + 5 <= (SELECT max(i) FROM no) THEN bo.i + 5 END) AS i, fell IS NOT NULL AS failed FROM bo LEFT JOIN fa USING (instrument, i)),
pd AS (SELECT no.day, no.i, new_setups, (SELECT count(*) FROM bo WHERE bo.i = no.i) AS breakouts, (SELECT count(*) FROM kn WHERE kn.i = no.i) AS j, (SELECT count(*) FROM kn WHERE kn.i = no.i AND failed) AS f FROM no LEFT JOIN ne USING (i) WHERE no.i >= (SELECT min(i) FROM su)),
fl AS (SELECT day, new_setups, breakouts, CAST(sum(j) OVER w AS BIGINT) AS judged, CAST(sum(f) OVER w AS BIGINT) AS failed FROM pd WINDOW w AS (ORDER BY i ROWS 19 PRECEDING))
SELECT *, round(CASE WHEN judged >= 5 THEN failed * 100.0 / judged END + 3e-10, 6) AS failed_pct FROM fl""",
}
