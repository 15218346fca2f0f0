"""SQL fragments that the oracles share: bars, features, strength and trend inputs as named subqueries."""

from __future__ import annotations

BARS = """
mu AS (SELECT round(avg(l_discount), 6) AS mu FROM lineitem),
day AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS trade_date, avg(l_discount) AS dc, avg(l_tax) AS tx, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
path AS (SELECT instrument, trade_date, tx, volume, round(100 * exp(sum(0.5 * (dc - mu)) OVER (PARTITION BY instrument ORDER BY trade_date)), 4) AS close FROM day, mu),
op AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY instrument ORDER BY trade_date), 100.0) AS open FROM path),
bars AS (SELECT instrument, trade_date, open, round(greatest(open, close) * (1 + tx / 10) + 3e-9, 4) AS high, round(least(open, close) * (1 - tx / 10) + 3e-9, 4) AS low, close, volume FROM op)
"""


def _w(name: str, n: int, prior: bool = False) -> str:
    a, b = (n, "1 PRECEDING") if prior else (n - 1, "CURRENT ROW")
    return f"{name} AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN {a} PRECEDING AND {b})"


def _full(agg: str, w: str, n: int, what: str = "*") -> str:
    return f"CASE WHEN count({what}) OVER {w} = {n} THEN {agg} OVER {w} END"


FEATURES = (
    """
tr AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS true_range, (close - pc) / nullif(pc, 0) AS daily_return
  FROM (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY trade_date) AS pc FROM bars)),
feat AS (SELECT instrument, trade_date, open, high, low, close, volume, daily_return, true_range,
"""
    + ",\n".join(
        [f"  {_full('avg(true_range)', 'w14', 14, 'true_range')} AS atr_14", f"  {_full('avg(true_range)', 'w14', 14, 'true_range')} / nullif(close, 0) * 100 AS atr_pct_14"]
        + [f"  {_full('avg(close)', f'w{n}', n)} AS sma_{n}" for n in (20, 50, 150, 200)]
        + [f"  {_full('max(high)', f'w{n}', n)} AS high_{n}" for n in (20, 50, 252)]
        + [f"  {_full('min(low)', f'w{n}', n)} AS low_{n}" for n in (20, 50, 252)]
        + [f"  {_full('avg(volume)', f'w{n}', n)} AS volume_avg_{n}" for n in (5, 10, 20, 50)]
        + [f"  volume / nullif({_full('avg(volume)', f'p{n}', n, 'volume')}, 0) AS volume_ratio_{n}" for n in (20, 50)]
        + [f"  {_full('stddev_pop(daily_return)', f'w{n}', n, 'daily_return')} AS volatility_{n}" for n in (20, 50)]
    )
    + "\n  FROM tr WINDOW "
    + ", ".join([_w(f"w{n}", n) for n in (5, 10, 14, 20, 50, 150, 200, 252)] + [_w(f"p{n}", n, True) for n in (20, 50)])
    + ")"
)

STRENGTH = """
ret AS (SELECT instrument, trade_date, """ + ", ".join(f"close / nullif(lag(close, {n}) OVER w, 0) - 1 AS ret_{n}" for n in (63, 126, 189, 252)) + """
  FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY trade_date)),
raw AS (SELECT *, 0.4 * ret_63 + 0.2 * ret_126 + 0.2 * ret_189 + 0.2 * ret_252 AS rs_raw FROM ret),
rk AS (SELECT *, CASE WHEN rs_raw IS NOT NULL THEN count(rs_raw) OVER (PARTITION BY trade_date) END AS population,
  rank() OVER (PARTITION BY trade_date, rs_raw IS NULL ORDER BY rs_raw) - 1 AS below, count(rs_raw) OVER (PARTITION BY trade_date, rs_raw) AS equal FROM raw),
rs AS (SELECT *, CASE WHEN rs_raw IS NULL THEN NULL WHEN population = 1 THEN 1.0 ELSE (below + 0.5 * (equal - 1)) / CAST(population - 1 AS DOUBLE) END AS rs_percentile FROM rk),
strength AS (SELECT *, CAST(1 + floor(98 * rs_percentile) AS INTEGER) AS rs_rank, CASE WHEN rs_raw IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END AS rs_status FROM rs)
"""

_SIDES = [("close", "sma_150"), ("close", "sma_200"), ("sma_150", "sma_200"), ("sma_200", "sma_200_prior"), ("sma_50", "sma_150"), ("sma_50", "sma_200"), ("close", "sma_50"), ("close", "low_252 * 1.25"), ("close", "high_252 * 0.75"), ("CAST(rs_rank AS DOUBLE)", "70.0")]
_NAMES = ("close_above_sma150", "close_above_sma200", "sma150_above_sma200", "sma200_rising", "sma50_above_sma150", "sma50_above_sma200", "close_above_sma50", "above_52w_low", "near_52w_high", "rs_rank_min")

TREND = (
    """
inputs AS (SELECT f.instrument, f.trade_date, f.close, sma_50, sma_150, sma_200, high_252, low_252, rs_rank,
  lag(sma_200, 21) OVER (PARTITION BY f.instrument ORDER BY f.trade_date) AS sma_200_prior FROM feat f JOIN strength s USING (instrument, trade_date)),
cond AS ("""
    + "\n  UNION ALL ".join(f"SELECT instrument, trade_date, {k} AS condition_id, '{n}' AS name, {m} AS measurement, {t} AS threshold, {m} {'>' if k <= 7 else '>='} {t} AS passed FROM inputs" for k, (n, (m, t)) in enumerate(zip(_NAMES, _SIDES, strict=True), 1))
    + """),
status AS (SELECT i.instrument, i.trade_date, i.close, i.rs_rank, c.n_passed,
  CASE WHEN c.n_known < 10 THEN 'INSUFFICIENT_DATA' WHEN c.n_passed = 10 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM inputs i JOIN (SELECT instrument, trade_date, count(passed) AS n_known, CAST(count(*) FILTER (WHERE passed) AS INTEGER) AS n_passed FROM cond GROUP BY 1, 2) c USING (instrument, trade_date))
"""
)

WEEKLY = """
weekly AS (SELECT instrument, CAST(date_trunc('week', trade_date) AS DATE) AS week_start, max(trade_date) AS week_end, arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, trade_date) AS close, sum(volume) AS volume, count(*) AS n_days FROM bars GROUP BY 1, 2)
"""

STAGE = """
back AS (SELECT instrument, week_start,
  CASE WHEN count(*) OVER a = 29 THEN sum(close) OVER a END AS before, CASE WHEN count(*) OVER b = 30 THEN avg(close) OVER b END AS sma_slope, CASE WHEN count(*) OVER c = 30 THEN avg(close) OVER c END AS sma_prior
  FROM weekly WINDOW a AS (PARTITION BY instrument ORDER BY week_start ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING),
    b AS (PARTITION BY instrument ORDER BY week_start ROWS BETWEEN 33 PRECEDING AND 4 PRECEDING), c AS (PARTITION BY instrument ORDER BY week_start ROWS BETWEEN 59 PRECEDING AND 30 PRECEDING)),
sma AS (SELECT b.instrument, b.trade_date, b.close, (before + b.close) / 30 AS sma_w, sma_slope, sma_prior FROM bars b JOIN back k ON k.instrument = b.instrument AND k.week_start = CAST(date_trunc('week', b.trade_date) AS DATE)),
slope AS (SELECT *, CASE WHEN sma_slope > 0 THEN (sma_w / sma_slope - 1.0) * 100.0 END AS slope_pct, CASE WHEN sma_prior > 0 THEN (sma_slope / sma_prior - 1.0) * 100.0 END AS prior_pct FROM sma),
stage AS (SELECT instrument, trade_date, sma_w, slope_pct, prior_pct,
  CASE WHEN sma_w IS NULL OR slope_pct IS NULL THEN 'INSUFFICIENT_DATA' WHEN close < sma_w AND slope_pct < -0.5 THEN 'STAGE_4' WHEN close > sma_w AND slope_pct > 0.5 THEN 'STAGE_2'
    WHEN abs(slope_pct) <= 0.5 THEN CASE WHEN prior_pct IS NULL THEN 'INSUFFICIENT_DATA' WHEN prior_pct >= 10 THEN 'STAGE_3' ELSE 'STAGE_1' END ELSE 'TRANSITION' END AS stage,
  isodow(trade_date) < 5 AS is_partial FROM slope)
"""


def r6(*names: str) -> str:
    """Named columns rounded to six decimals, off the grid of half units."""
    return ", ".join(f"round({n} + 3e-10, 6) AS {n}" for n in names)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"
