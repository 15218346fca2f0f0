"""Queries of patterns, trades, portfolios and ledgers. Sequential folds have no SQL; their parts that SQL can check are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import streaming as st
from barloom.operators import backtest, falls, labels, ledger, market, patterns, pivots, scores, tracking
from barloom.operators.backtest import TradeRule
from barloom.operators.features import by_day, daily_features
from barloom.operators.trend import screened
from barloom.plans.detections import DETECTIONS
from barloom.plans.screen import rounded
from barloom.plans.sql import BARS, FEATURES, STRENGTH, TREND, with_
from barloom.sources import store
from barloom.sources.bars import model_bars, sessions, table

RULES = [TradeRule("hold_low8"), TradeRule("target20", target_pct=20.0), TradeRule("trail50", trail="sma50"), TradeRule("cross5", max_extension_pct=5.0)]


def signals(s, d):
    """Fresh passing bars; the screen has their level, so bars are screened once."""
    level = F.when(F.col("status") == "PASS", F.col("high_20")).alias("level")
    rows = screened(model_bars(s, d)).select("instrument", "trade_date", "rs_rank", "status", level)
    return backtest.fresh(rows).select("instrument", "trade_date", "level", F.col("rs_rank").cast("double").alias("score"))


def trades(s, d):
    """Trades on signals(), whose bars the screen has passed on."""
    return backtest.screened_trades(screened(model_bars(s, d), makers=(backtest.watched_columns,)).withColumn("level", F.col("high_20")), RULES)


def ledger_of(s, d):
    """The whole ledger of the rules over all bars, with the regime of each session. Signals, trades and what is made of them are few and read several times, so they are kept."""
    at, bars = st.scratch(s), model_bars(s, d)

    def kept(name, rows):
        with store.released(s):
            rows.write.parquet(f"{at}/{name}")
        return s.read.parquet(f"{at}/{name}")

    found = kept("signals", signals(s, d))
    made = kept("trades", backtest.run_trades(bars, found, RULES))
    rules = s.createDataFrame([(r.name, r.watch) for r in RULES], "rule string, watch int")
    regimes = market.regimes(market.breadth(market.panel(bars)), min_members=10).select("trade_date", F.col("breadth_on").alias("on"))
    watched = kept("watched", ledger.watches(found, made, bars, rules))
    return ledger.ledger(watched, made, kept("taken", backtest.taken_trades(made, bars)), sessions(bars), kept("regimes", regimes))


def order_events(s, d):
    """Orders as events of a ledger: an entry each, an exit 30 days on of those that are filled, skipped ones, and each day of orders closed for each priority."""
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("rule"), F.col("o_custkey").alias("instrument"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    kind = F.when(F.col("o_orderkey") % 17 == 0, "SKIPPED_NO_SLOT").otherwise("ENTRY")
    none = F.lit(None).cast("double")
    enter = o.select("rule", "instrument", F.col("day").alias("event_date"), kind.alias("event_type"), F.col("day").alias("scan_date"), "price", none.alias("ret_pct"), F.col("o_orderkey").cast("string").alias("note"))
    leave = o.where("o_orderkey % 17 <> 0 AND o_orderstatus = 'F'").select("rule", "instrument", F.date_add("day", 30).alias("event_date"), F.lit("EXIT").alias("event_type"), F.col("day").alias("scan_date"), (F.col("price") * 1.1).alias("price"), (((F.col("o_orderkey") % 41) - 20) / 2).alias("ret_pct"), F.col("o_orderkey").cast("string").alias("note"))
    closed = o.select("rule", "day").distinct().select("rule", F.lit(None).cast("long").alias("instrument"), F.col("day").alias("event_date"), F.lit("DAY_CLOSED").alias("event_type"), F.lit(None).cast("date").alias("scan_date"), none.alias("price"), none.alias("ret_pct"), F.lit(None).cast("string").alias("note"))
    return enter.unionByName(leave).unionByName(closed)


def kept_events(s, d):
    """What a ledger kept of order_events() up to the end of 1996: some are missing, some have another price; one priority is not in it yet."""
    rows = order_events(s, d).where("event_date <= DATE '1996-12-31' AND rule <> '5-LOW' AND coalesce(note % 97, 1) <> 0")
    return rows.withColumn("price", F.when(F.col("note") % 89 == 0, F.col("price") + 1).otherwise(F.col("price")))


def month_end(following):
    """Whether a bar is the last of its month, by the day of the bar behind it."""
    return ~F.last_day("trade_date").eqNullSafe(F.last_day(following))


def bases(s, d):
    """Bases as of every bar."""
    return patterns.detect_bases(model_bars(s, d))


def month_bases(s, d):
    """Bases as of the last bar of each month, by the month's last day; their status follows the bars since their start."""
    return patterns.detect_bases(model_bars(s, d), asked=month_end(F.lead("trade_date").over(by_day()))).withColumn("as_of", F.last_day("as_of"))


def month_status(s, d):
    """Status of month_bases(), with the verdicts of the months' last bars."""
    verdicts = screened(model_bars(s, d), makers=(lambda f: f.put_day("following", -1),)).where(month_end("following")).select("instrument", "trade_date", "status")
    return patterns.base_status(month_bases(s, d), model_bars(s, d), verdicts)


def ema20(s, d):
    """EMA(20) seeded by the mean of the first 20 closes: a closed form over the ordered array of one instrument."""
    bars = model_bars(s, d).groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("trade_date", "close"))).alias("b")).where(F.size("b") >= 20)
    seed = F.aggregate(F.slice("b", 1, 20), F.lit(0.0), lambda a, x: a + x["close"]) / 20
    rest = F.slice("b", 21, F.greatest(F.size("b") - 20, F.lit(0)))
    last = F.aggregate(rest, seed, lambda e, x: e + (x["close"] - e) * (2 / 21))
    return bars.select("instrument", F.element_at("b", -1)["trade_date"].alias("trade_date"), last.alias("ema_20"))


def falls_of_all(s, d):
    """The second detector as of every bar."""
    return falls.daily_falls(model_bars(s, d))


def candidate_signals(s, d):
    """New signals among the detector's candidate days."""
    bars = model_bars(s, d)
    days = falls.daily_falls(bars).where("candidate").select("instrument", "as_of", "pivot")
    return patterns.new_signals(days.join(sessions(bars).withColumnRenamed("trade_date", "as_of"), "as_of").select("instrument", "as_of", "pivot", "session"))


def ten_bars():
    """High and low of the last ten bars."""
    w = by_day().rowsBetween(-9, 0)
    return F.max("high").over(w).alias("right_high"), F.min("low").over(w).alias("right_low")


def parts_of():
    """The parts of score v2 of a bar, from its rolling features and ten_bars()."""
    depth = lambda hi, lo: (1 - F.col(lo) / F.col(hi)) * 100
    above = lambda a, b: (F.col(a) / F.col(b) - 1) * 100
    parts = {"right_side_range_pct": depth("right_high", "right_low"), "final_contraction_pct": depth("high_20", "low_20"), "base_depth_pct": depth("high_50", "low_50"), "above_sma50_pct": above("close", "sma_50"), "stack_margin_pct": above("sma_50", "sma_200"), "prior_advance_pct": above("high_50", "low_252")}
    return [c.alias(n) for n, c in parts.items()]


def score_parts(s, d):
    """The parts of score v2 as of each bar."""
    return daily_features(model_bars(s, d)).select("*", *ten_bars()).select("instrument", "trade_date", *parts_of())


def rescored_signals(s, d):
    """signals() with the score of their own bar, whose features the screen has."""
    rows = screened(model_bars(s, d), own=ten_bars()).select("instrument", "trade_date", "status", F.col("high_20").alias("level"), *parts_of())
    return scores.day_ranked(backtest.fresh(rows).select("instrument", "trade_date", "level", scores.score_of().alias("score")))


def last_days(s, d):
    """Each base that daily_detections finds, as of the last bar that has it."""
    return tracking.daily_detections(model_bars(s, d)).groupBy("instrument", "base_start").agg(F.max("trade_date").alias("as_of"))


def level_signals(s, d):
    """Passing days as candidates, their 20-bar high as pivot."""
    bars = model_bars(s, d)
    days = screened(bars).where("status = 'PASS'").select("instrument", "trade_date", F.col("high_20").alias("pivot"))
    return patterns.new_signals(days.join(F.broadcast(sessions(bars)), "trade_date").select("instrument", F.col("trade_date").alias("as_of"), "pivot", "session"))


QUERIES = {
    "dom48_falls": falls_of_all,
    "dom49_daily_scan": lambda s, d: falls.scan_summary(falls.daily_falls(model_bars(s, d))),
    "dom50_candidate_signals": candidate_signals,
    "dom54_score_v2": lambda s, d: rounded(score_parts(s, d).select("instrument", "trade_date", scores.score_of().alias("score")), "score"),
    "dom54_rescored_signals": lambda s, d: rounded(rescored_signals(s, d), "score"),
    "dom33_pivots": lambda s, d: rounded(pivots.pivots(model_bars(s, d), last_days(s, d)), "distance_pct", "tightness_pct"),
    "dom50_new_signals": level_signals,
    "dom60_signals": signals,
    "dom57_trades": lambda s, d: rounded(trades(s, d), "entry", "exit", "ret_pct"),
    "dom57_trade_stats": lambda s, d: rounded(labels.trade_stats(trades(s, d).withColumn("hold_days", F.datediff("exit_date", "entry_date")), "rule", "exit_kind"), "win_rate", "avg_ret", "median_ret", "profit_factor", "avg_hold_days", "avg_win", "avg_loss"),
    "dom58_portfolio": lambda s, d: rounded(backtest.portfolio(trades(s, d), model_bars(s, d)), "value", "cash"),
    "dom64_ledger": lambda s, d: rounded(ledger_of(s, d), "price", "ret_pct"),
    "dom65_ledger_update": lambda s, d: rounded(ledger.plan_update(order_events(s, d), kept_events(s, d)), "price", "ret_pct"),
    "dom66_ledger_status": lambda s, d: rounded(ledger.status(kept_events(s, d)), "win_rate", "avg_ret", "profit_factor"),
    "dom31_bases": bases,
    "dom32_measures": lambda s, d: rounded(patterns.measures(bases(s, d)), "first_depth", "last_depth", "mean_ratio", "worst_ratio", "shrinking_share"),
    "dom34_tiers": lambda s, d: patterns.tiers(bases(s, d)),
    "dom37_base_status": lambda s, d: rounded(month_status(s, d), "level"),
    "dom40_base_history": lambda s, d: patterns.status_history(month_status(s, d)),
    "win12_ema20": lambda s, d: rounded(ema20(s, d), "ema_20"),
}

_EVENTS = """ev AS (SELECT o_orderpriority AS rule, o_custkey AS instrument, CAST(o_orderdate AS DATE) AS event_date, CASE WHEN o_orderkey % 17 = 0 THEN 'SKIPPED_NO_SLOT' ELSE 'ENTRY' END AS event_type, CAST(o_orderdate AS DATE) AS scan_date, o_totalprice AS price, CAST(NULL AS DOUBLE) AS ret_pct, o_orderkey AS k FROM orders
  UNION ALL SELECT o_orderpriority, o_custkey, CAST(o_orderdate AS DATE) + 30, 'EXIT', CAST(o_orderdate AS DATE), o_totalprice * 1.1, (o_orderkey % 41 - 20) / 2.0, o_orderkey FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderstatus = 'F'
  UNION ALL SELECT DISTINCT o_orderpriority, NULL, CAST(o_orderdate AS DATE), 'DAY_CLOSED', CAST(NULL AS DATE), NULL, NULL, NULL FROM orders),
st AS (SELECT * REPLACE (CASE WHEN k % 89 = 0 THEN price + 1 ELSE price END AS price) FROM ev WHERE event_date <= DATE '1996-12-31' AND rule <> '5-LOW' AND coalesce(k % 97, 1) <> 0),
la AS (SELECT rule, max(event_date) AS last FROM st WHERE event_type = 'DAY_CLOSED' GROUP BY rule)"""

_SCORE2 = """pt AS (SELECT instrument, trade_date, (1 - min(low) OVER t / max(high) OVER t) * 100 AS a, (1 - low_20 / high_20) * 100 AS b, (1 - low_50 / high_50) * 100 AS c, (close / sma_50 - 1) * 100 AS d, (sma_50 / sma_200 - 1) * 100 AS e, (high_50 / low_252 - 1) * 100 AS f FROM feat
  WINDOW t AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
pp AS (SELECT instrument, trade_date, [""" + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(100.0, greatest(0.0, ({worst} - {c}) / ({worst} - {best}) * 100)) END" for c, (worst, best) in zip("abcdef", scores.PARTS.values(), strict=True)) + """] AS p FROM pt),
s2 AS (SELECT instrument, trade_date, list_aggregate(p, 'sum') / nullif(list_aggregate(p, 'count'), 0) AS score FROM pp)"""

ORACLES = {
    "dom54_score_v2": with_(BARS, FEATURES, _SCORE2) + "SELECT instrument, trade_date, round(score + 3e-10, 6) AS score FROM s2",
    "dom54_rescored_signals": with_(BARS, FEATURES, STRENGTH, TREND, _SCORE2) + """, k AS (SELECT instrument, trade_date, rs_rank, status, row_number() OVER (PARTITION BY instrument ORDER BY trade_date) AS n FROM status),
p AS (SELECT *, lag(n) OVER (PARTITION BY instrument ORDER BY n) AS last FROM k WHERE status = 'PASS')
SELECT p.instrument, p.trade_date, f.high_20 AS level, round(score + 3e-10, 6) AS score, CAST(row_number() OVER (PARTITION BY p.trade_date ORDER BY score DESC NULLS LAST, p.instrument) AS INTEGER) AS day_rank FROM p JOIN feat f USING (instrument, trade_date) LEFT JOIN s2 USING (instrument, trade_date) WHERE n > 1 AND (last IS NULL OR n - last > 10)""",
    "dom65_ledger_update": with_(_EVENTS) + """, u AS (SELECT ev.*, last, round(price, 4) AS p FROM ev LEFT JOIN la USING (rule)), v AS (SELECT st.*, round(price, 4) AS p FROM st JOIN la USING (rule)),
o AS (SELECT *, 'NEW' AS state FROM u WHERE last IS NULL OR event_date > last
  UNION ALL SELECT u.*, 'DERIVED_ONLY' FROM u WHERE event_date <= last AND NOT EXISTS (SELECT 1 FROM v WHERE v.rule = u.rule AND v.event_type = u.event_type AND v.event_date = u.event_date AND v.instrument IS NOT DISTINCT FROM u.instrument AND v.scan_date IS NOT DISTINCT FROM u.scan_date AND v.p IS NOT DISTINCT FROM u.p)
  UNION ALL SELECT v.* EXCLUDE (p), NULL, v.p, 'STORED_ONLY' FROM v WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.event_date <= u.last AND v.rule = u.rule AND v.event_type = u.event_type AND v.event_date = u.event_date AND v.instrument IS NOT DISTINCT FROM u.instrument AND v.scan_date IS NOT DISTINCT FROM u.scan_date AND v.p IS NOT DISTINCT FROM u.p))
SELECT rule, instrument, event_date, event_type, scan_date, round(price + 3e-10, 6) AS price, round(ret_pct + 3e-10, 6) AS ret_pct, CAST(k AS VARCHAR) AS note, state FROM o""",
    "dom66_ledger_status": with_(_EVENTS) + """, op AS (SELECT rule, count(*) AS n_open FROM st e WHERE event_type = 'ENTRY' AND NOT EXISTS (SELECT 1 FROM st x WHERE x.event_type = 'EXIT' AND x.rule = e.rule AND x.instrument = e.instrument AND x.scan_date = e.scan_date) GROUP BY rule),
su AS (SELECT rule, max(event_date) FILTER (WHERE event_type = 'DAY_CLOSED') AS through, count(*) FILTER (WHERE event_type = 'EXIT') AS closed, count(*) FILTER (WHERE ret_pct > 0) AS w, sum(ret_pct) AS s, sum(ret_pct) FILTER (WHERE ret_pct > 0) AS g, -sum(ret_pct) FILTER (WHERE ret_pct < 0) AS l, count(*) FILTER (WHERE event_type = 'SKIPPED_NO_SLOT') AS skipped FROM st GROUP BY rule)
SELECT rule, through, closed, round(CASE WHEN closed > 0 THEN w * 100.0 / closed ELSE 0.0 END + 3e-10, 6) AS win_rate, round(CASE WHEN closed > 0 THEN s / closed ELSE 0.0 END + 3e-10, 6) AS avg_ret, round(CASE WHEN l > 0 THEN coalesce(g, 0) / l END + 3e-10, 6) AS profit_factor, coalesce(n_open, 0) AS n_open, skipped FROM su LEFT JOIN op USING (rule)""",
    "dom33_pivots": with_(BARS, DETECTIONS).replace("WITH ", "WITH RECURSIVE ", 1) + """, num AS (SELECT *, row_number() OVER w AS n, high >= max(high) OVER r AS swing FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY trade_date), r AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
bs AS (SELECT b.*, f.n AS first, l.n AS last FROM (SELECT instrument, base_start, max(trade_date) AS as_of FROM dt GROUP BY 1, 2) b JOIN num f ON f.instrument = b.instrument AND f.trade_date = base_start JOIN num l ON l.instrument = b.instrument AND l.trade_date = as_of),
bb AS (SELECT bs.instrument, base_start, as_of, first, last, num.n, trade_date, high, low, close, swing AND num.n > 5 AND num.n + 5 <= last AS swing FROM (SELECT *, unnest(generate_series(first, last)) AS k FROM bs) bs JOIN num ON num.instrument = bs.instrument AND num.n = bs.k),
one AS (SELECT instrument, base_start, as_of, first, last, arg_max(close, n) AS close, max(high) FILTER (WHERE n = first) AS base_high, max(n) FILTER (WHERE swing AND n > first) AS peak_n, arg_max(high, n) FILTER (WHERE swing AND n > first) AS peak,
  max(high) FILTER (WHERE n > last - 10) AS rs, arg_max(n, (high, n)) FILTER (WHERE n > last - 10) AS rs_n, min(low) FILTER (WHERE n > last - 10) AS rs_low FROM bb GROUP BY ALL),
so AS (SELECT instrument, base_start, n, high, row_number() OVER (PARTITION BY instrument, base_start ORDER BY high DESC, n) AS k FROM bb WHERE swing),
-- from the highest swing down: a new level where a high is beyond the last level's zone
cl AS (SELECT instrument, base_start, k, n, high AS top, 1 AS level FROM so WHERE k = 1
  UNION ALL SELECT so.instrument, so.base_start, so.k, so.n, CASE WHEN so.high >= cl.top * (1 - 1.5 / 100) THEN cl.top ELSE so.high END, CASE WHEN so.high >= cl.top * (1 - 1.5 / 100) THEN level ELSE level + 1 END FROM cl JOIN so ON so.instrument = cl.instrument AND so.base_start = cl.base_start AND so.k = cl.k + 1),
lv AS (SELECT instrument, base_start, 0 AS o, 'BASE_HIGH' AS source, base_high AS piv, first AS at_n FROM one UNION ALL SELECT instrument, base_start, 1, 'LAST_PEAK', peak, peak_n FROM one WHERE peak_n IS NOT NULL UNION ALL SELECT instrument, base_start, 2, 'RIGHT_SIDE_HIGH', rs, rs_n FROM one
  UNION ALL SELECT instrument, base_start, 3, 'REPEATED', max(top), max(n) FROM cl GROUP BY instrument, base_start, level HAVING count(*) >= 2),
nm AS (SELECT instrument, base_start, piv, at_n, arg_min(source, o) AS source FROM lv GROUP BY 1, 2, 3, 4),
vi AS (SELECT bb.instrument, bb.base_start, bb.last, n, trade_date, low, high, bb.close, piv, at_n, source, bb.high >= piv * (1 - 1.5 / 100) AS inside FROM bb JOIN nm ON nm.instrument = bb.instrument AND nm.base_start = bb.base_start),
vr AS (SELECT *, sum(CASE WHEN inside AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, base_start, piv, at_n ORDER BY n) AS run FROM (SELECT *, lag(inside) OVER (PARTITION BY instrument, base_start, piv, at_n ORDER BY n) AS was FROM vi)),
rn AS (SELECT instrument, base_start, piv, at_n, run, bool_or(close > piv) AS above, max(n) < max(last) AS over FROM vr WHERE inside GROUP BY 1, 2, 3, 4, 5),
ct AS (SELECT instrument, base_start, piv, at_n, count(*) AS touches, count(*) FILTER (WHERE over AND NOT above) AS rejections FROM rn GROUP BY 1, 2, 3, 4),
af AS (SELECT instrument, base_start, piv, at_n, max(trade_date) FILTER (WHERE n = at_n) AS pivot_date, max(high) FILTER (WHERE n > at_n AND n > last - 10) AS hi, min(low) FILTER (WHERE n > at_n AND n > last - 10) AS lo FROM vi GROUP BY 1, 2, 3, 4),
pr AS (SELECT *, CASE WHEN (1 - rs_low / rs) * 100 <= 5 AND rs >= close THEN rs_n ELSE coalesce(peak_n, first) END AS p_n, coalesce(peak_n, first) AS s_n FROM one)
SELECT nm.instrument, nm.base_start, as_of, source, nm.piv AS "pivot", pivot_date, round((nm.piv / close - 1) * 100 + 3e-10, 6) AS distance_pct, coalesce(touches, 0) AS touches, coalesce(rejections, 0) AS rejections, round((1 - lo / hi) * 100 + 3e-10, 6) AS tightness_pct,
  nm.at_n = p_n AND nm.piv = CASE WHEN p_n = rs_n AND (1 - rs_low / rs) * 100 <= 5 AND rs >= close THEN rs WHEN peak_n IS NOT NULL THEN peak ELSE base_high END AS is_primary, nm.at_n = s_n AND nm.piv = CASE WHEN peak_n IS NOT NULL THEN peak ELSE base_high END AS is_structural
FROM nm JOIN pr ON pr.instrument = nm.instrument AND pr.base_start = nm.base_start JOIN af ON af.instrument = nm.instrument AND af.base_start = nm.base_start AND af.piv = nm.piv AND af.at_n = nm.at_n
  LEFT JOIN ct ON ct.instrument = nm.instrument AND ct.base_start = nm.base_start AND ct.piv = nm.piv AND ct.at_n = nm.at_n""",
    "dom50_new_signals": with_(BARS, FEATURES, STRENGTH, TREND).replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session FROM (SELECT DISTINCT trade_date FROM bars)),
c AS (SELECT s.instrument, s.trade_date AS as_of, f.high_20 AS "pivot", session FROM status s JOIN feat f USING (instrument, trade_date) JOIN n USING (trade_date) WHERE status = 'PASS'),
o AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY session) AS k FROM c),
-- day by day: the last signal's session and pivot are carried along
f AS (SELECT instrument, k, as_of, session, "pivot", session AS s0, "pivot" AS p0, true AS new FROM o WHERE k = 1
  UNION ALL SELECT o.instrument, o.k, o.as_of, o.session, o."pivot", CASE WHEN t THEN o.session ELSE s0 END, CASE WHEN t THEN o."pivot" ELSE p0 END, t
  FROM (SELECT o.*, f.s0, f.p0, o.session <> f.session + 1 OR abs(o."pivot" / f.p0 - 1) * 100 > 0.01 OR o.session - f.s0 >= 20 AS t FROM f JOIN o ON o.instrument = f.instrument AND o.k = f.k + 1) o)
SELECT instrument, as_of, "pivot" FROM f WHERE new""",
    "dom60_signals": with_(BARS, FEATURES, STRENGTH, TREND) + """, k AS (SELECT instrument, trade_date, rs_rank, status, row_number() OVER (PARTITION BY instrument ORDER BY trade_date) AS n FROM status),
-- passing bars stand eleven bars or more behind the passing bar before, and have ten bars before them less only at the start
p AS (SELECT *, lag(n) OVER (PARTITION BY instrument ORDER BY n) AS last FROM k WHERE status = 'PASS')
SELECT p.instrument, p.trade_date, f.high_20 AS level, CAST(p.rs_rank AS DOUBLE) AS score FROM p JOIN feat f USING (instrument, trade_date) WHERE n > 1 AND (last IS NULL OR n - last > 10)""",
    "win12_ema20": "WITH RECURSIVE " + BARS.strip() + """, n AS (SELECT instrument, trade_date, close, row_number() OVER (PARTITION BY instrument ORDER BY trade_date) AS n FROM bars),
e AS (SELECT instrument, CAST(20 AS BIGINT) AS n, sum(close) / 20 AS ema FROM n WHERE n <= 20 GROUP BY 1 HAVING count(*) = 20 UNION ALL SELECT e.instrument, n.n, e.ema + (n.close - e.ema) * (2 / CAST(21 AS DOUBLE)) FROM e JOIN n ON n.instrument = e.instrument AND n.n = e.n + 1)
SELECT e.instrument, n.trade_date, round(e.ema + 3e-10, 6) AS ema_20 FROM e JOIN n USING (instrument, n) WHERE (e.instrument, e.n) IN (SELECT instrument, max(n) FROM n GROUP BY 1)""",
}
