"""SQL of operators.tracking.daily_detections, which several oracles share."""

from __future__ import annotations

DETECTIONS = """
dt0 AS (SELECT instrument, trade_date, close, volume / CASE WHEN count(*) OVER f = 50 THEN nullif(avg(volume) OVER f, 0) END AS ratio, count(*) OVER o AS n, max(high) OVER o AS level, arg_min(trade_date, (-high, trade_date)) OVER o AS base_start,
  max(high) OVER y AS piv, arg_min(trade_date, (-high, trade_date)) OVER y AS pivot_date FROM bars
  WINDOW f AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 55 PRECEDING AND 6 PRECEDING), y AS (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
dt AS (SELECT *, CASE WHEN close <= level * (1 - 30.0 / 100) THEN 'INVALIDATED' WHEN coalesce(close > level AND ratio >= 1.5, false) THEN 'BREAKOUT' ELSE 'FORMING' END AS state, lag(base_start) OVER w AS last_base, lag(piv) OVER w AS last_pivot FROM dt0 WHERE n = 50 WINDOW w AS (PARTITION BY instrument ORDER BY trade_date))
"""
