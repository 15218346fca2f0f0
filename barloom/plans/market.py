"""Queries of market state, corporate actions and labels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom import streaming as st
from barloom.functions import first_reason, r6
from barloom.operators import adjust, health, labels, market, strength
from barloom.operators.features import by_day, daily_features
from barloom.plans.screen import rounded
from barloom.plans.sql import BARS, FEATURES, STRENGTH, TREND, WEEKLY, r6 as sql6, with_
from barloom.plans.temporal import ACTIONS
from barloom.sources.bars import actions, model_bars, sectors, table, trade_bars

#: What came after a bar is read off the list of its next ten closes; its level is the high of 50 bars as it stood the bar before.
PANEL = """
ahead AS (SELECT instrument, trade_date, list(close) OVER nxt AS closes, lag(high_50, 1) OVER inst AS level, lag(high_50, 11) OVER inst AS level_before, lag(volume_avg_50, 1) OVER inst AS volume_before FROM feat
  WINDOW inst AS (PARTITION BY instrument ORDER BY trade_date), nxt AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
pan AS (SELECT feat.*, rs_rank, status, feat.close >= 20 AS eligible, level, level_before, volume_before, closes[5] AS close_5, closes[10] AS close_judged, list_min(closes[1:5]) AS low_hold, list_min(closes) AS low_judged, coalesce(len(closes), 0) AS n_after
  FROM feat JOIN status USING (instrument, trade_date) JOIN ahead USING (instrument, trade_date))
"""
_N = "count(*) FILTER (WHERE eligible AND {})"
BREADTH = "days AS (SELECT trade_date, count(*) FILTER (WHERE eligible) AS n, " + ", ".join(
    [f"{_N.format(f'sma_{k} IS NOT NULL')} AS n_{k}, {_N.format(f'close > sma_{k}')} AS above_{k}" for k in (50, 150, 200)]
    + [f"{_N.format('daily_return > 0')} AS advances", f"{_N.format('daily_return < 0')} AS declines", f"{_N.format('high >= high_252 * 0.99999')} AS new_highs", f"{_N.format('low <= low_252 * 1.00001')} AS new_lows"]
    + ["count(*) FILTER (WHERE status = 'PASS') AS n_pass", "count(*) FILTER (WHERE status <> 'INSUFFICIENT_DATA') AS n_judged"]
    + ["sum(volume) FILTER (WHERE eligible AND daily_return > 0) AS up_volume", "sum(volume) FILTER (WHERE eligible AND daily_return < 0) AS down_volume", "avg(daily_return) FILTER (WHERE eligible) AS mean_return"]
) + " FROM pan GROUP BY trade_date)"
ALL = (BARS, FEATURES, STRENGTH, TREND, PANEL, BREADTH)


def pan(s, d):
    return market.panel(model_bars(s, d))


def raw(s, d):
    """What would have traded, had the model bars been adjusted for the actions; prices to four decimals."""
    bars = model_bars(s, d)
    out = adjust.unadjust(bars, actions(bars))
    return out.withColumns({c: F.round(F.col(c) + 3e-9, 4) for c in ("open", "high", "low", "close")}), actions(bars)


def labelled(s, d):
    bars = model_bars(s, d)
    feat = daily_features(bars).select("instrument", "trade_date", "high_20")
    return labels.forward_labels(bars.join(feat, ["instrument", "trade_date"]), F.col("high_20"))


def trades(s, d):
    """Line items as trades: return from discount and tax, held l_quantity days, by year of shipping."""
    t = table(s, d, "lineitem")
    return t.select(F.year("l_shipdate").alias("year"), F.round((F.col("l_discount") - F.col("l_tax")) * 100, 4).alias("ret_pct"), F.col("l_quantity").alias("hold_days"))


def with_indices(panel):
    """The panel with a fifth of the instruments as an index of large ones, and a fifth as one of small ones."""
    return panel.withColumns({"large": F.col("instrument") % 5 == 0, "small": F.col("instrument") % 5 == 1})


def day_readings(s, d):
    """All readings of the market's days, for a market of ten eligible stocks or more and three verdicts."""
    # Counts, sectors and breakouts read the panel, which is computed once.
    path = f"{st.scratch(s)}/panel"
    with_indices(pan(s, d).select(*health.PANEL)).write.parquet(path)
    p = s.read.parquet(path)
    counts = health.day_counts(p)
    judged = health.judged_breakouts(market.breakouts(p), counts.select("trade_date"))
    return health.readings(counts, health.sectors_up(health.sector_days(p, sectors(s, d))), judged, min_universe=10, min_judged=3)


def scored(s, d):
    """Relative strength as a score, the 20-bar return after as its outcome."""
    bars = model_bars(s, d)
    w = by_day()
    after = bars.select("instrument", "trade_date", ((F.lead("close", 20).over(w) / F.col("close") - 1) * 100).alias("outcome"))
    return strength.relative_strength(bars).select("instrument", "trade_date", "rs_raw").join(after, ["instrument", "trade_date"]).where("rs_raw IS NOT NULL AND outcome IS NOT NULL")


def eligibility(s, d):
    """First failing rule of each bar's date."""
    w = by_day()
    b = model_bars(s, d)
    turnover = F.col("close") * F.col("volume")
    mean = lambda n: F.when(F.count(F.lit(1)).over(w.rowsBetween(-(n - 1), 0)) == n, F.avg(turnover).over(w.rowsBetween(-(n - 1), 0)))
    rows = b.select("instrument", "trade_date", "close", mean(20).alias("tv20"), mean(50).alias("tv50"), F.row_number().over(w).alias("n"))
    reason = first_reason(
        (F.col("instrument") % 25 == 24, "SERIES"), (F.col("close") < 20, "PRICE"), (F.col("tv20").isNull() | (F.col("tv20") < 1000), "TURNOVER_20"), (F.col("tv50").isNull() | (F.col("tv50") < 1000), "TURNOVER_50"), (F.col("n") < 253, "HISTORY"),
    )
    return rows.select("instrument", "trade_date", reason.isNull().alias("eligible"), reason.alias("reason"))


def invalid(s, d):
    """Reasons why a landed bar is no bar: trade bars with open and high of every 7th instrument swapped and some volumes below zero."""
    b = trade_bars(s, d)
    odd = F.col("instrument") % 7 == 0
    b = b.select("instrument", "trade_date", F.when(odd, F.col("high")).otherwise(F.col("open")).alias("open"), F.when(odd, F.col("open")).otherwise(F.col("high")).alias("high"), "low", "close", F.when(F.col("instrument") % 11 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"))
    tests = [("open above high", F.col("open") > F.col("high")), ("close above high", F.col("close") > F.col("high")), ("low above open", F.col("low") > F.col("open")), ("low above close", F.col("low") > F.col("close")), ("volume below zero", F.col("volume") < 0)]
    why = F.concat_ws("; ", *[F.when(t, F.lit(n)) for n, t in tests])
    return b.select("instrument", "trade_date", why.alias("reasons")).where("reasons <> ''")


def base_score(s, d):
    """Trend component: distance from the 252-bar high, 21-bar slope and spread of averages, each clipped to 0-100, weighed over what is there."""
    f = daily_features(model_bars(s, d)).withColumn("prior", F.lag("sma_200", 21).over(by_day()))
    clip = lambda x, worst, best: F.when(x.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), (x - worst) / (best - worst) * 100.0)))
    parts = [(40.0, clip((F.col("high_252") - F.col("close")) / F.col("high_252") * 100, 25.0, 0.0)), (30.0, clip((F.col("sma_200") / F.col("prior") - 1) * 100, 0.0, 8.0)), (30.0, clip((F.col("sma_50") / F.col("sma_200") - 1) * 100, 0.0, 20.0))]
    total = sum((F.when(p.isNotNull(), w).otherwise(0.0) for w, p in parts), F.lit(0.0))
    points = sum((F.coalesce(p * w, F.lit(0.0)) for w, p in parts), F.lit(0.0))
    return f.select("instrument", "trade_date", r6(points / F.when(total > 0, total)).alias("trend_score"), total.alias("weight"))


def final_rank(s, d):
    score = base_score(s, d).where("trend_score IS NOT NULL")
    pct, n = strength.midrank(F.col("trend_score"), "trade_date")
    return score.select("instrument", "trade_date", "trend_score", r6(pct * 100).alias("percentile"), n.alias("population"))


def curve(s, d):
    return model_bars(s, d).select("instrument", F.col("trade_date").alias("day"), F.col("close").alias("value"))


LABELS = ["ret_5", "ret_10", "ret_20", "ret_40", "ret_60", "best_60", "worst_60"]
STATS = ["win_rate", "avg_ret", "median_ret", "avg_win", "avg_loss", "profit_factor", "avg_hold_days"]
READ = [
    "index", "index_200", "index_200_prior", "index_high", "ad_line", "above_50", "above_150", "above_200", "stacked", "rising_200", "pct_above_50", "pct_above_150", "pct_above_200", "ad_ratio", "highs_lows", "above_50_change", "own_gap",
    "ad_line_gap", "pass_share", "leader_change", "highs_20", "highs_52", "sectors_up", "leaders_gap", "distribution", "accumulation_days", "up_down_value", "cluster", "up_on_volume", "success", "held", "failure", "median_return",
    "near_pivot", "held_any", "thrust_ratio", "large_above_50", "small_above_50",
]

QUERIES = {
    "dom70_panel": lambda s, d: pan(s, d).select("instrument", "trade_date", "eligible", "level", "level_before", "close_5", "close_judged", "low_hold", "low_judged", "n_after", "status"),
    "agg02_breadth": lambda s, d: rounded(market.breadth(pan(s, d)), "mean_return"),
    "dom71_breakouts": lambda s, d: rounded(market.breakouts(pan(s, d)), "ret_5", "ret_judged"),
    "dom59_regimes": lambda s, d: rounded(market.regimes(market.breadth(pan(s, d)), min_members=10), "index", "index_mean"),
    "dom73_readings": lambda s, d: rounded(health.thrust_days(day_readings(s, d)), *READ),
    "dom74_health": lambda s, d: rounded(health.score(day_readings(s, d), min_judged=3, cap_judged=2), *health.PILLARS, "raw"),
    "dom76_rotation": lambda s, d: rounded(market.rotation(model_bars(s, d), sectors(s, d)), "line", "ratio", "momentum"),
    "dom06_cumulative_factors": lambda s, d: rounded(adjust.cumulative(actions(model_bars(s, d))), "cumulative"),
    "dom07_adjusted_bars": lambda s, d: rounded(adjust.adjust(*raw(s, d)), "open", "high", "low", "close", "volume", "factor"),
    "dom09_gaps": lambda s, d: rounded(adjust.gaps(*raw(s, d)), "jump", "residual"),
    "dom55_forward_labels": lambda s, d: rounded(labelled(s, d), *LABELS),
    "dom56_first_hit": lambda s, d: labels.first_hit(model_bars(s, d)),
    "agg11_trade_stats": lambda s, d: rounded(labels.trade_stats(trades(s, d), "year"), *STATS),
    "agg12_equity_stats": lambda s, d: rounded(labels.equity_stats(curve(s, d), "instrument"), "total_ret", "cagr", "max_drawdown", "sharpe"),
    "agg13_wilson": lambda s, d: trades(s, d).groupBy("year").agg(F.count("*").alias("n"), F.count(F.when(F.col("ret_pct") > 0, 1)).alias("k")).select("year", "n", "k", *[r6(c).alias(n) for n, c in zip(("low", "high"), labels.wilson(F.col("k"), F.col("n")), strict=True)]),
    "agg15_quintiles": lambda s, d: rounded(labels.quintiles(scored(s, d), "rs_raw", "outcome", "trade_date"), "mean_outcome", "win_rate"),
    "agg16_information_coefficient": lambda s, d: rounded(labels.information_coefficient(scored(s, d), "rs_raw", "outcome", "trade_date"), "ic"),
    "fil01_invalid_bars": invalid,
    "fil05_eligibility": eligibility,
    "dom51_trend_score": base_score,
    "dom53_score_rank": final_rank,
}

_CLIP = "least(100.0, greatest(0.0, ({x} - {w}) / ({b} - {w}) * 100.0))"
SCORE = f"""
sc0 AS (SELECT *, lag(sma_200, 21) OVER (PARTITION BY instrument ORDER BY trade_date) AS prior FROM feat),
sc1 AS (SELECT instrument, trade_date, CASE WHEN high_252 IS NOT NULL THEN {_CLIP.format(x='(high_252 - close) / high_252 * 100', w='25.0', b='0.0')} END AS a,
  CASE WHEN prior IS NOT NULL THEN {_CLIP.format(x='(sma_200 / prior - 1) * 100', w='0.0', b='8.0')} END AS b, CASE WHEN sma_200 IS NOT NULL THEN {_CLIP.format(x='(sma_50 / sma_200 - 1) * 100', w='0.0', b='20.0')} END AS c FROM sc0),
sc2 AS (SELECT *, CASE WHEN a IS NULL THEN 0.0 ELSE 40.0 END + CASE WHEN b IS NULL THEN 0.0 ELSE 30.0 END + CASE WHEN c IS NULL THEN 0.0 ELSE 30.0 END AS weight FROM sc1),
score AS (SELECT instrument, trade_date, round((coalesce(a * 40.0, 0.0) + coalesce(b * 30.0, 0.0) + coalesce(c * 30.0, 0.0)) / CASE WHEN weight > 0 THEN weight END + 3e-10, 6) AS trend_score, CAST(weight AS DOUBLE) AS weight FROM sc2)
"""
SCORED = """
outc AS (SELECT s.instrument, s.trade_date, rs_raw, outcome FROM strength s JOIN (SELECT instrument, trade_date, (lead(close, 20) OVER (PARTITION BY instrument ORDER BY trade_date) / close - 1) * 100 AS outcome FROM bars) o USING (instrument, trade_date) WHERE rs_raw IS NOT NULL AND outcome IS NOT NULL)
"""
RAW = """
cum0 AS (SELECT instrument, ex_date, exp(sum(ln(factor)) OVER (PARTITION BY instrument ORDER BY ex_date DESC)) AS cumulative FROM act),
raw0 AS (SELECT b.*, coalesce(c.cumulative, 1.0) AS factor FROM bars b ASOF LEFT JOIN cum0 c ON c.instrument = b.instrument AND b.trade_date < c.ex_date),
traded AS (SELECT instrument, trade_date, round(open / factor + 3e-9, 4) AS open, round(high / factor + 3e-9, 4) AS high, round(low / factor + 3e-9, 4) AS low, round(close / factor + 3e-9, 4) AS close, volume, factor FROM raw0)
"""
READINGS = with_(*ALL) + """, lp AS (SELECT *, coalesce(status = 'PASS' AND rs_rank >= 80, false) AS leader FROM pan),
lq AS (SELECT *, lag(leader, 20) OVER w AS leader_then, lag(close, 20) OVER w AS close_then FROM lp WINDOW w AS (PARTITION BY instrument ORDER BY trade_date)),
more AS (SELECT trade_date, count(*) FILTER (WHERE eligible AND high >= high_20 * 0.99999) AS highs_of_20, count(*) FILTER (WHERE leader) AS leaders, count(*) FILTER (WHERE leader_then AND close_then > 0) AS led_n,
  avg(close / close_then - 1) FILTER (WHERE leader_then AND close_then > 0) AS led_return, count(*) FILTER (WHERE status = 'PASS' AND close >= high_50 * 0.95 AND volatility_20 < volatility_50) AS near,
  sum(close * volume) FILTER (WHERE eligible AND daily_return > 0) AS value_up, sum(close * volume) FILTER (WHERE eligible AND daily_return < 0) AS value_down, sum(volume) FILTER (WHERE eligible) AS own_volume,
  avg(daily_return) AS index_return, sum(volume) AS index_volume, avg(daily_return) FILTER (WHERE instrument % 5 = 0) AS large_return, avg(daily_return) FILTER (WHERE instrument % 5 = 1) AS small_return FROM lq GROUP BY trade_date),
c0 AS (SELECT * FROM days JOIN more USING (trade_date)),
s0 AS (SELECT n_name AS sector, trade_date, exp(sum(coalesce(ln(1 + avg(daily_return)), 0)) OVER (PARTITION BY n_name ORDER BY trade_date)) AS line FROM feat JOIN supplier ON s_suppkey = instrument JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
s1 AS (SELECT *, CASE WHEN row_number() OVER w >= 50 THEN avg(line) OVER (PARTITION BY sector ORDER BY trade_date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS m, lag(line, 21) OVER w AS a, lag(line, 63) OVER w AS b, lag(line, 126) OVER w AS c FROM s0 WINDOW w AS (PARTITION BY sector ORDER BY trade_date)),
s2 AS (SELECT trade_date, (CASE WHEN count(m + a) >= 8 THEN count(*) FILTER (WHERE line > m AND line > a) * 100.0 / count(m + a) END + CASE WHEN count(m + b) >= 8 THEN count(*) FILTER (WHERE line > m AND line > b) * 100.0 / count(m + b) END
  + CASE WHEN count(m + c) >= 8 THEN count(*) FILTER (WHERE line > m AND line > c) * 100.0 / count(m + c) END) / 3 AS sectors_up FROM s1 GROUP BY 1),
no AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM c0),
bo AS (SELECT i, low_hold >= level AS held, close_judged >= level * 1.05 AS success, low_judged < level * 0.97 AS failed, (close_5 / close - 1) * 100 AS r5, (close_judged / close - 1) * 100 AS rj FROM pan JOIN no USING (trade_date)
  WHERE status = 'PASS' AND level <= level_before AND close > level AND volume_before > 0 AND volume >= 1.4 * volume_before AND n_after = 10),
jd AS (SELECT no.i, count(*) AS judged, count(*) FILTER (WHERE success) * 100.0 / count(*) AS success, count(*) FILTER (WHERE held) * 100.0 / count(*) AS held, count(*) FILTER (WHERE failed) * 100.0 / count(*) AS failure, (median(r5) + median(rj)) / 2 AS median_return
  FROM no JOIN bo ON bo.i + 10 BETWEEN no.i - 19 AND no.i GROUP BY 1),
c1 AS (SELECT c0.*, no.i, n >= 10 AS big, sectors_up, jd.judged, success, held, failure, median_return, exp(sum(CASE WHEN n >= 10 THEN coalesce(ln(1 + mean_return), 0) ELSE 0 END) OVER w) AS own, exp(sum(coalesce(ln(1 + index_return), 0)) OVER w) AS ix, exp(sum(coalesce(ln(1 + large_return), 0)) OVER w) AS lg, exp(sum(coalesce(ln(1 + small_return), 0)) OVER w) AS sm, sum(advances - declines) OVER w AS ad,
  CASE WHEN n >= 10 THEN above_50 / nullif(n_50, 0) * 100 END AS p50, own_volume > lag(own_volume) OVER w AND n >= 10 AND lag(n) OVER w >= 10 AS oh, index_volume > lag(index_volume) OVER w AS xh
  FROM c0 JOIN no USING (trade_date) LEFT JOIN s2 USING (trade_date) LEFT JOIN jd USING (i) WINDOW w AS (ORDER BY c0.trade_date)),
c2 AS (SELECT *, CASE WHEN xh AND ix / lag(ix) OVER w - 1 <= -0.002 THEN 1 ELSE 0 END AS xd, CASE WHEN xh AND ix / lag(ix) OVER w - 1 >= 0.002 THEN 1 ELSE 0 END AS xa, CASE WHEN oh AND coalesce(mean_return, 0) <= -0.002 THEN 1 ELSE 0 END AS od,
  CASE WHEN i >= 50 THEN avg(ix) OVER (ORDER BY trade_date ROWS 49 PRECEDING) END AS m50, CASE WHEN i >= 50 THEN avg(lg) OVER (ORDER BY trade_date ROWS 49 PRECEDING) END AS lg50, CASE WHEN i >= 50 THEN avg(sm) OVER (ORDER BY trade_date ROWS 49 PRECEDING) END AS sm50, CASE WHEN i >= 150 THEN avg(ix) OVER (ORDER BY trade_date ROWS 149 PRECEDING) END AS m150, CASE WHEN i >= 200 THEN avg(ix) OVER (ORDER BY trade_date ROWS 199 PRECEDING) END AS m200,
  avg(new_highs * 100.0 / n) OVER t AS hi, avg(new_lows * 100.0 / n) OVER t AS lo, avg(highs_of_20 * 100.0 / n) OVER t AS hs, sum(CASE WHEN big THEN 1 ELSE 0 END) OVER t AS ten FROM c1 WINDOW w AS (ORDER BY trade_date), t AS (ORDER BY trade_date ROWS 9 PRECEDING)),
c3 AS (SELECT *, lag(m200, 20) OVER w AS m200p, lag(big, 10) OVER w AS big10, lag(big, 20) OVER w AS big20, lag(big, 21) OVER w AS big21, lag(leaders, 20) OVER w AS ld20, lag(own, 20) OVER w AS own20, lag(own, 21) OVER w AS own21, lag(ix, 21) OVER w AS ix21,
  CASE WHEN i > 25 THEN sum(xd) OVER q END AS dist, CASE WHEN i > 25 THEN sum(xa) OVER q END AS acc, CASE WHEN i > 25 AND sum(CASE WHEN big THEN 1 ELSE 0 END) OVER (ORDER BY trade_date ROWS 25 PRECEDING) = 26 THEN sum(od) OVER q END AS odist,
  max(ad) OVER y AS adh, min(ad) OVER y AS adl, max(ix) OVER y AS ixh FROM c2 WINDOW w AS (ORDER BY trade_date), q AS (ORDER BY trade_date ROWS 24 PRECEDING), y AS (ORDER BY trade_date ROWS 251 PRECEDING)),
rd AS (SELECT trade_date, n, big, ix AS index, m200 AS index_200, m200p AS index_200_prior, ixh AS index_high, ad AS ad_line, CASE WHEN ix > m50 THEN 100.0 WHEN m50 IS NOT NULL THEN 0.0 END AS above_50, CASE WHEN lg > lg50 THEN 100.0 WHEN lg50 IS NOT NULL THEN 0.0 END AS large_above_50, CASE WHEN sm > sm50 THEN 100.0 WHEN sm50 IS NOT NULL THEN 0.0 END AS small_above_50, CASE WHEN ix > m150 THEN 100.0 WHEN m150 IS NOT NULL THEN 0.0 END AS above_150,
  CASE WHEN ix > m200 THEN 100.0 WHEN m200 IS NOT NULL THEN 0.0 END AS above_200, CASE WHEN m200 IS NOT NULL THEN CASE WHEN m50 > m150 THEN 50.0 ELSE 0 END + CASE WHEN m150 > m200 THEN 50.0 ELSE 0 END END AS stacked, CASE WHEN m200 > m200p THEN 100.0 WHEN m200p IS NOT NULL THEN 0.0 END AS rising_200,
  p50 AS pct_above_50, CASE WHEN big THEN c3.above_150 / nullif(n_150, 0) * 100 END AS pct_above_150, CASE WHEN big THEN c3.above_200 / nullif(n_200, 0) * 100 END AS pct_above_200,
  CASE WHEN sum(CASE WHEN big THEN 1 ELSE 0 END) OVER v = 20 THEN sum(advances - declines) OVER v / nullif(sum(advances + declines) OVER v, 0) END AS ad_ratio, CASE WHEN ten = 10 THEN hi / nullif(hi + lo, 0) END AS highs_lows, p50 - lag(p50, 10) OVER w AS above_50_change,
  CASE WHEN big AND big21 THEN (own / own21 - ix / ix21) * 100 END AS own_gap, CASE WHEN big AND i >= 252 THEN (adh - ad) / nullif(adh - adl, 0) END AS ad_line_gap, CASE WHEN big THEN n_pass * 100.0 / n END AS pass_share, CASE WHEN big THEN CAST(n_pass AS BIGINT) END AS passes,
  CASE WHEN big AND big10 THEN CAST(lag(n_pass, 10) OVER w AS BIGINT) END AS passes_then, CASE WHEN big AND big20 THEN (leaders / nullif(ld20, 0) - 1) * 100 END AS leader_change, CASE WHEN ten = 10 THEN hs END AS highs_20, CASE WHEN ten = 10 THEN hi END AS highs_52, CASE WHEN big THEN sectors_up END AS sectors_up,
  CASE WHEN big AND big20 AND ld20 > 0 AND led_n >= 5 THEN (led_return - (own / own20 - 1)) * 100 END AS leaders_gap, coalesce(0.6 * dist + 0.4 * odist, dist, odist) AS distribution, acc AS accumulation_days, CASE WHEN big THEN sum(value_up) OVER t / nullif(sum(value_down) OVER t, 0) END AS up_down_value,
  CASE WHEN i > 25 THEN sum(xd) OVER t END AS cluster, acc / nullif(acc + dist, 0) AS up_on_volume, CASE WHEN big THEN coalesce(judged, 0) END AS judged, CASE WHEN big AND judged >= 3 THEN success END AS success, CASE WHEN big AND judged >= 3 THEN held END AS held, CASE WHEN big AND judged >= 3 THEN failure END AS failure,
  CASE WHEN big AND judged >= 3 THEN median_return END AS median_return, CASE WHEN big THEN near * 100.0 / n END AS near_pivot, CASE WHEN big THEN held END AS held_any, CASE WHEN count(advances / nullif(advances + declines, 0)) OVER t = 10 THEN avg(advances * 100.0 / nullif(advances + declines, 0)) OVER t END AS thrust_ratio
  FROM c3 WINDOW w AS (ORDER BY trade_date), v AS (ORDER BY trade_date ROWS 19 PRECEDING), t AS (ORDER BY trade_date ROWS 9 PRECEDING))
"""


def rung(x: str, a: float, b: float, up: bool = True) -> str:
    """0 to 100 between a and b, or the other way round."""
    share = f"least(1.0, greatest(0.0, ({x} - {a}) / ({b} - {a})))"
    return f"CASE WHEN {x} IS NOT NULL THEN 100.0 * {share if up else f'(1.0 - {share})'} END"


def mean_sql(*parts: tuple[float, str]) -> str:
    return "(" + " + ".join(f"coalesce(({p}) * {k}.0, 0.0)" for k, p in parts) + ") / nullif(" + " + ".join(f"CASE WHEN ({p}) IS NULL THEN 0.0 ELSE {k}.0 END" for k, p in parts) + ", 0)"


HEALTH = ", pl AS (SELECT *, CASE WHEN index_200 IS NOT NULL THEN " + mean_sql((20, "above_50"), (20, "above_150"), (20, "above_200"), (20, "stacked"), (10, "rising_200"), (5, "large_above_50"), (5, "small_above_50")) + """ END AS index_trend,
CASE WHEN big THEN """ + mean_sql((20, rung("pct_above_50", 30, 70)), (15, rung("pct_above_150", 30, 70)), (15, rung("pct_above_200", 30, 70)), (15, rung("ad_ratio", -0.15, 0.15)), (15, f"coalesce({rung('highs_lows', 0.2, 0.8)}, 50.0)"), (10, rung("above_50_change", -15, 15)), (10, rung("own_gap", -4, 4))) + """ END AS breadth,
CASE WHEN big THEN """ + mean_sql((25, rung("pass_share", 3, 20)), (20, rung("leader_change", -40, 40)), (10, rung("highs_20", 2, 12)), (10, rung("highs_52", 0.5, 5)), (20, rung("sectors_up", 20, 80)), (15, rung("leaders_gap", -3, 5))) + """ END AS leadership,
""" + mean_sql(
    (30, "CASE WHEN distribution <= 2 THEN 100.0 WHEN distribution <= 4 THEN 100 - 20 * (distribution - 2) WHEN distribution <= 5 THEN 60 - 30 * (distribution - 4) WHEN distribution <= 6 THEN 30 - 30 * (distribution - 5) WHEN distribution > 6 THEN 0.0 END"), (20, rung("accumulation_days", 0, 6)),
    (20, "CASE WHEN up_down_value <= 0.67 THEN 0.0 WHEN up_down_value <= 1 THEN 50 * (up_down_value - 0.67) / 0.33 WHEN up_down_value <= 1.5 THEN 50 + 100 * (up_down_value - 1) WHEN up_down_value > 1.5 THEN 100.0 END"), (20, rung("cluster", 0, 4, False)),
    (10, f"coalesce({rung('up_on_volume', 0.3, 0.7)}, CASE WHEN accumulation_days IS NOT NULL THEN 50.0 END)"),
) + """ AS accumulation,
CASE WHEN judged >= 3 THEN """ + mean_sql((30, rung("success", 15, 50)), (25, rung("held", 30, 70)), (20, rung("failure", 20, 60, False)), (15, rung("median_return", -3, 4)), (10, rung("near_pivot", 1, 6))) + """ END AS breakouts FROM rd),
rw AS (SELECT *, """ + mean_sql((25, "index_trend"), (25, "breadth"), (20, "leadership"), (15, "accumulation"), (15, "breakouts")) + """ AS raw, index_trend IS NOT NULL AND breadth IS NOT NULL AND leadership IS NOT NULL AND accumulation IS NOT NULL AND breakouts IS NOT NULL AS complete FROM pl),
cp AS (SELECT *, coalesce(index < index_200 AND index_200 < index_200_prior AND pct_above_50 < 30, false) AS c1, coalesce(cluster >= 5, false) AS c2, coalesce(judged >= 2 AND 100 - held_any > 60, false) AS c3, coalesce(1 - passes / nullif(passes_then, 0) >= 0.333, false) AS c4,
  coalesce(index >= index_high * 0.97 AND ad_line_gap > 0.25, false) AS c5, NOT complete AS c6, CASE WHEN raw >= 80 THEN 0 WHEN raw >= 65 THEN 1 WHEN raw >= 50 THEN 2 WHEN raw >= 35 THEN 3 WHEN raw IS NOT NULL THEN 4 END AS k FROM rw),
cq AS (SELECT *, greatest(k, CASE WHEN c1 OR c3 THEN 3 WHEN c2 OR c4 OR c6 THEN 2 WHEN c5 THEN 1 ELSE 0 END) AS k2 FROM cp)
SELECT trade_date, """ + sql6("index_trend", "breadth", "leadership", "accumulation", "breakouts", "raw") + """, ['Strong', 'Constructive', 'Mixed', 'Weak', 'Adverse'][k + 1] AS raw_label, CASE WHEN raw IS NOT NULL THEN ['Strong', 'Constructive', 'Mixed', 'Weak', 'Adverse'][k2 + 1] END AS label, complete,
  CASE WHEN raw IS NOT NULL THEN ['full', 'full', 'half', 'none', 'none'][k2 + 1] END AS exposure,
  CASE WHEN raw IS NOT NULL THEN concat_ws(',', CASE WHEN c1 THEN 'downtrend' END, CASE WHEN c2 THEN 'distribution' END, CASE WHEN c3 THEN 'failures' END, CASE WHEN c4 THEN 'pass_collapse' END, CASE WHEN c5 THEN 'divergence' END, CASE WHEN c6 THEN 'incomplete' END) END AS caps FROM cq"""

ORACLES = {
    "dom70_panel": with_(BARS, FEATURES, STRENGTH, TREND, PANEL) + "SELECT instrument, trade_date, eligible, level, level_before, close_5, close_judged, low_hold, low_judged, n_after, status FROM pan",
    "agg02_breadth": with_(*ALL) + "SELECT * REPLACE (round(mean_return + 3e-10, 6) AS mean_return) FROM days",
    "dom71_breakouts": with_(BARS, FEATURES, STRENGTH, TREND, PANEL) + """SELECT instrument, trade_date, level, low_hold >= level AS held, close_judged >= level * 1.05 AS success, low_judged < level * 0.97 AS failed,
  round((close_5 / close - 1) * 100 + 3e-10, 6) AS ret_5, round((close_judged / close - 1) * 100 + 3e-10, 6) AS ret_judged FROM pan
  WHERE status = 'PASS' AND level <= level_before AND close > level AND volume_before > 0 AND volume >= 1.4 * volume_before AND n_after = 10""",
    "dom59_regimes": with_(*ALL) + """, ix AS (SELECT trade_date, n_50, above_50, exp(sum(coalesce(ln(1 + mean_return), 0)) OVER (ORDER BY trade_date)) AS index FROM days),
m AS (SELECT *, CASE WHEN count(*) OVER w = 50 THEN avg(index) OVER w END AS index_mean FROM ix WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT trade_date, round(index + 3e-10, 6) AS index, round(index_mean + 3e-10, 6) AS index_mean, n_50 >= 10 AND coalesce(above_50 / nullif(n_50, 0) >= 0.4, false) AS breadth_on, coalesce(index > index_mean, false) AS index_on FROM m""",
    "dom73_readings": READINGS + "SELECT trade_date, n, big, " + sql6(*READ) + """, passes, passes_then, judged,
  coalesce(thrust_ratio > 61.5 AND coalesce(lag(thrust_ratio) OVER (ORDER BY trade_date), 0) <= 61.5 AND min(thrust_ratio) OVER (ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) < 40, false) AS thrust FROM rd""",
    "dom74_health": READINGS + HEALTH,
    "dom76_rotation": with_(BARS, WEEKLY) + """, st AS (SELECT instrument, week_start, close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY week_start), 0) - 1 AS change FROM weekly),
j AS (SELECT st.*, n_name AS sector FROM st JOIN supplier ON s_suppkey = instrument JOIN nation ON s_nationkey = n_nationkey WHERE change IS NOT NULL),
p AS (SELECT sector, week_start, avg(change) AS change FROM j GROUP BY 1, 2), m AS (SELECT week_start, avg(change) AS market FROM j GROUP BY 1),
l AS (SELECT sector, week_start, exp(sum(ln(1 + change) - ln(1 + market)) OVER (PARTITION BY sector ORDER BY week_start)) AS line FROM p JOIN m USING (week_start)),
q AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN line / avg(line) OVER w * 100 END AS ratio FROM l WINDOW w AS (PARTITION BY sector ORDER BY week_start ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, ratio / lag(ratio, 4) OVER (PARTITION BY sector ORDER BY week_start) * 100 AS momentum FROM q)
SELECT sector, week_start, round(line + 3e-10, 6) AS line, round(ratio + 3e-10, 6) AS ratio, round(momentum + 3e-10, 6) AS momentum,
  CASE WHEN momentum IS NULL THEN NULL WHEN ratio > 100 AND momentum > 100 THEN 'LEADING' WHEN ratio > 100 THEN 'WEAKENING' WHEN momentum > 100 THEN 'IMPROVING' ELSE 'LAGGING' END AS quadrant FROM z""",
    "dom06_cumulative_factors": with_(BARS, ACTIONS, RAW) + "SELECT instrument, ex_date, round(cumulative + 3e-10, 6) AS cumulative FROM cum0",
    "dom07_adjusted_bars": with_(BARS, ACTIONS, RAW) + "SELECT instrument, trade_date, " + ", ".join(f"round({c} * factor + 3e-10, 6) AS {c}" for c in ("open", "high", "low", "close")) + ", round(volume / factor + 3e-10, 6) AS volume, round(factor + 3e-10, 6) AS factor FROM traded",
    "dom09_gaps": with_(BARS, ACTIONS, RAW) + """, g AS (SELECT instrument, trade_date, open, lag(close) OVER w AS pc, lag(trade_date) OVER w AS pd FROM traded WINDOW w AS (PARTITION BY instrument ORDER BY trade_date)),
j AS (SELECT *, open / pc AS jump FROM g WHERE pc > 0 AND abs(open / pc - 1) >= 0.3),
x AS (SELECT j.instrument, j.trade_date, exp(sum(ln(a.factor))) AS explained FROM j JOIN act a ON a.instrument = j.instrument AND a.ex_date > pd AND a.ex_date <= j.trade_date GROUP BY 1, 2),
r AS (SELECT j.*, jump / coalesce(explained, 1.0) AS residual FROM j LEFT JOIN x USING (instrument, trade_date))
SELECT instrument, trade_date, round(jump + 3e-10, 6) AS jump, round(residual + 3e-10, 6) AS residual, residual <= 0.7 AS blocks,
  (SELECT arg_min(h.ratio, (abs(r.jump - h.v), h.ratio)) FROM (VALUES ('1:2', 1 / 2.0), ('2:3', 2 / CAST(3 AS DOUBLE)), ('1:3', 1 / CAST(3 AS DOUBLE)), ('3:4', 0.75), ('1:4', 0.25), ('1:5', 0.2), ('1:10', 0.1)) AS h(ratio, v)) AS hint FROM r""",
    "dom55_forward_labels": with_(BARS, FEATURES) + """, f0 AS (SELECT instrument, trade_date, close, high, low, volume, high_20 AS level, row_number() OVER w AS n,
  coalesce(CASE WHEN count(volume) OVER p = 50 THEN avg(volume) OVER p END > 0 AND volume >= 1.5 * CASE WHEN count(volume) OVER p = 50 THEN avg(volume) OVER p END, false) AS loud, count(*) OVER a AS n_bars,
  """ + ", ".join(f"(lead(close, {h}) OVER w / close - 1.0) * 100.0 AS ret_{h}" for h in (5, 10, 20, 40, 60)) + """, max(high) OVER a AS mx, min(low) OVER a AS mn, min(close) OVER t AS low_10, count(*) OVER t AS n_10 FROM feat
  WINDOW w AS (PARTITION BY instrument ORDER BY trade_date), p AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING), t AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
f1 AS (SELECT *, CASE """ + " ".join(f"WHEN lead(loud_close, {k}) OVER w > level THEN {k}" for k in range(1, 21)) + """ END AS breakout_day FROM (SELECT *, CASE WHEN loud THEN close END AS loud_close FROM f0) WINDOW w AS (PARTITION BY instrument ORDER BY trade_date)),
f2 AS (SELECT *, CASE breakout_day """ + " ".join(f"WHEN {k} THEN lead(low_10, {k}) OVER w" for k in range(1, 21)) + """ END AS low_after, CASE breakout_day """ + " ".join(f"WHEN {k} THEN lead(n_10, {k}) OVER w" for k in range(1, 21)) + """ END AS k
  FROM f1 WINDOW w AS (PARTITION BY instrument ORDER BY trade_date)),
o AS (SELECT * REPLACE (CAST(breakout_day AS INTEGER) AS breakout_day), CASE WHEN level IS NULL THEN NULL WHEN breakout_day IS NOT NULL THEN true WHEN n_bars >= 20 THEN false END AS breakout,
  CASE WHEN breakout_day IS NULL THEN NULL WHEN low_after < level THEN true WHEN k = 10 THEN false END AS failed FROM f2)
SELECT instrument, trade_date, close, level, n_bars, breakout_day, breakout, failed, n_bars = 60 AND (level IS NULL OR breakout IS NOT NULL) AND (breakout_day IS NULL OR failed IS NOT NULL) AS complete,
  """ + ", ".join(f"round(ret_{h} + 3e-10, 6) AS ret_{h}" for h in (5, 10, 20, 40, 60)) + """,
  round(CASE WHEN n_bars = 60 THEN (mx / close - 1.0) * 100.0 END + 3e-10, 6) AS best_60, round(CASE WHEN n_bars = 60 THEN (mn / close - 1.0) * 100.0 END + 3e-10, 6) AS worst_60 FROM o""",
    "dom56_first_hit": with_(BARS) + """, n AS (SELECT *, count(*) OVER (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS k FROM bars),
h AS (SELECT *, CASE """ + " ".join(f"WHEN lead(high, {k}) OVER w >= close * (1 + 10 / 100.0) THEN {k}" for k in range(1, 61)) + """ END AS rise,
  CASE """ + " ".join(f"WHEN lead(low, {k}) OVER w <= close * (1 - 7 / 100.0) THEN {k}" for k in range(1, 61)) + """ END AS fall FROM n WINDOW w AS (PARTITION BY instrument ORDER BY trade_date))
SELECT instrument, trade_date, CASE WHEN fall IS NOT NULL AND (rise IS NULL OR fall <= rise) THEN 'DOWN' WHEN rise IS NOT NULL THEN 'UP' WHEN k = 60 THEN 'NONE' END AS hit,
  CAST(CASE WHEN fall IS NOT NULL AND (rise IS NULL OR fall <= rise) THEN fall ELSE rise END AS INTEGER) AS hit_day FROM h""",
    "agg11_trade_stats": """WITH t AS (SELECT year(l_shipdate) AS year, round((l_discount - l_tax) * 100, 4) AS r, l_quantity AS h FROM lineitem)
SELECT CAST(year AS INTEGER) AS year, count(*) AS trades, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) + 3e-10, 6) AS win_rate, round(avg(r) + 3e-10, 6) AS avg_ret, round(median(r) + 3e-10, 6) AS median_ret, round(avg(r) FILTER (WHERE r > 0) + 3e-10, 6) AS avg_win,
  round(avg(r) FILTER (WHERE r <= 0) + 3e-10, 6) AS avg_loss, round(sum(r) FILTER (WHERE r > 0) / nullif(-sum(r) FILTER (WHERE r <= 0), 0) + 3e-10, 6) AS profit_factor, round(avg(h) + 3e-10, 6) AS avg_hold_days FROM t GROUP BY 1""",
    "agg12_equity_stats": with_(BARS) + """, c AS (SELECT instrument, trade_date, close, close / max(close) OVER w - 1 AS fall, close / lag(close) OVER w AS step FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY trade_date)),
a AS (SELECT instrument, arg_min(close, trade_date) AS f, arg_max(close, trade_date) AS l, date_diff('day', min(trade_date), max(trade_date)) AS days, min(fall) AS deepest, avg(step - 1) AS m, stddev_samp(step - 1) AS sd, count(*) AS n FROM c GROUP BY 1)
SELECT instrument, round((l / f - 1) * 100 + 3e-10, 6) AS total_ret, round(CASE WHEN days > 0 AND l > 0 THEN (pow(l / f, 365.25 / days) - 1) * 100 END + 3e-10, 6) AS cagr, round(deepest * 100 + 3e-10, 6) AS max_drawdown, round(CASE WHEN sd > 0 THEN m / sd * sqrt(252.0) END + 3e-10, 6) AS sharpe FROM a WHERE n > 1""",
    "agg13_wilson": """WITH t AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (WHERE round((l_discount - l_tax) * 100, 4) > 0) AS k FROM lineitem GROUP BY 1)
SELECT *, round((k / n + 1.96 * 1.96 / 2 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / 4 / n / n)) / (1 + 1.96 * 1.96 / n) + 3e-10, 6) AS low, round((k / n + 1.96 * 1.96 / 2 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / 4 / n / n)) / (1 + 1.96 * 1.96 / n) + 3e-10, 6) AS high FROM t""",
    "agg15_quintiles": with_(BARS, STRENGTH, SCORED) + """, q AS (SELECT *, least(5, CAST(1 + floor((rank() OVER (PARTITION BY trade_date ORDER BY rs_raw) + (count(*) OVER (PARTITION BY trade_date, rs_raw) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY trade_date) * 5) AS INTEGER)) AS fifth FROM outc)
SELECT fifth, count(*) AS n, round(avg(outcome) + 3e-10, 6) AS mean_outcome, round(avg(CASE WHEN outcome > 0 THEN 1.0 ELSE 0.0 END) + 3e-10, 6) AS win_rate FROM q GROUP BY 1""",
    "agg16_information_coefficient": with_(BARS, STRENGTH, SCORED) + """, q AS (SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY rs_raw) + (count(*) OVER (PARTITION BY trade_date, rs_raw) - 1) / 2.0 AS a, rank() OVER (PARTITION BY trade_date ORDER BY outcome) + (count(*) OVER (PARTITION BY trade_date, outcome) - 1) / 2.0 AS b FROM outc)
SELECT trade_date, count(*) AS n, round(corr(a, b) + 3e-10, 6) AS ic FROM q GROUP BY 1 HAVING count(*) >= 10""",
    "fil01_invalid_bars": """WITH t AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS trade_date, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS o, max(l_extendedprice / l_quantity) AS h, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS close, sum(l_quantity) AS v FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
b AS (SELECT instrument, trade_date, CASE WHEN instrument % 7 = 0 THEN h ELSE o END AS open, CASE WHEN instrument % 7 = 0 THEN o ELSE h END AS high, low, close, CASE WHEN instrument % 11 = 0 THEN -v ELSE v END AS volume FROM t),
w AS (SELECT instrument, trade_date, concat_ws('; ', CASE WHEN open > high THEN 'open above high' END, CASE WHEN close > high THEN 'close above high' END, CASE WHEN low > open THEN 'low above open' END, CASE WHEN low > close THEN 'low above close' END, CASE WHEN volume < 0 THEN 'volume below zero' END) AS reasons FROM b)
SELECT * FROM w WHERE reasons <> ''""",
    "fil05_eligibility": with_(BARS) + """, t AS (SELECT instrument, trade_date, close, CASE WHEN count(*) OVER a = 20 THEN avg(close * volume) OVER a END AS tv20, CASE WHEN count(*) OVER b = 50 THEN avg(close * volume) OVER b END AS tv50, row_number() OVER w AS n FROM bars
  WINDOW w AS (PARTITION BY instrument ORDER BY trade_date), a AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
r AS (SELECT instrument, trade_date, CASE WHEN instrument % 25 = 24 THEN 'SERIES' WHEN close < 20 THEN 'PRICE' WHEN tv20 IS NULL OR tv20 < 1000 THEN 'TURNOVER_20' WHEN tv50 IS NULL OR tv50 < 1000 THEN 'TURNOVER_50' WHEN n < 253 THEN 'HISTORY' END AS reason FROM t)
SELECT instrument, trade_date, reason IS NULL AS eligible, reason FROM r""",
    "dom51_trend_score": with_(BARS, FEATURES, SCORE) + "SELECT * FROM score",
    "dom53_score_rank": with_(BARS, FEATURES, SCORE) + """, k AS (SELECT instrument, trade_date, trend_score, count(*) OVER (PARTITION BY trade_date) AS population, rank() OVER (PARTITION BY trade_date ORDER BY trend_score) - 1 AS below, count(*) OVER (PARTITION BY trade_date, trend_score) AS equal FROM score WHERE trend_score IS NOT NULL)
SELECT instrument, trade_date, trend_score, population, round(CASE WHEN population = 1 THEN 1.0 ELSE (below + 0.5 * (equal - 1)) / CAST(population - 1 AS DOUBLE) END * 100 + 3e-10, 6) AS percentile FROM k""",
}
