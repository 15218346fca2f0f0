"""Signals to trades to portfolios. Window features come from Spark; only the fold over one instrument's trades, and over one
scenario's days, is sequential and runs as a grouped map."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.features import by_day
from barloom.operators.frames import Frames


@dataclass(frozen=True)
class TradeRule:
    """One scenario. trail: '' or 'sma50'; a target or trail that is None or '' is off."""

    name: str
    stop_pct: float = 8.0
    target_pct: float | None = None
    trail: str = ""
    trail_after: int = 10
    horizon: int = 60
    watch: int = 20
    volume_ratio: float = 1.2
    max_extension_pct: float | None = None
    cost_bps: float = 15.0


TRADE = "rule string, instrument long, signal_date date, entry_date date, entry double, exit_date date, exit double, exit_kind string, ret_pct double, score double, hold_bars int"


def first_at(test: np.ndarray, start: int, stop: int) -> int:
    """The first index in [start, stop) where the test holds, or a number beyond all."""
    hit = np.flatnonzero(test[start:stop])
    return start + int(hit[0]) if len(hit) else 1 << 30


def trades_of(pdf: pd.DataFrame, r: TradeRule) -> list[tuple]:
    """Trades of one rule on one instrument, bars in order of date.

    A signal is watched from the next bar on, until it breaks out, its watch ends or a newer one takes its place. Signals up
    to and including the bar of an exit are passed over. On one bar the stop goes before target, trail and time.
    """
    close, high, low, line, volume, base = (pdf[c].to_numpy(float) for c in ("close", "high", "low", "sma_50", "volume", "base"))
    loud, level, day, n = (base > 0) & (volume >= r.volume_ratio * base), pdf["level"].to_numpy(float), pdf["trade_date"].to_numpy(), len(pdf)
    signals, out, free, cost = np.flatnonzero(~np.isnan(level)), [], 0, r.cost_bps / 10_000
    for i, s in enumerate(signals):
        if s < free:
            continue
        until = min(s + r.watch + 1, n, signals[i + 1] + 0 if i + 1 < len(signals) else n)
        ready = loud & (close > level[s])
        if r.max_extension_pct is not None:
            ready &= (np.concatenate([[np.inf], close[:-1]]) <= level[s]) & (close <= level[s] * (1 + r.max_extension_pct / 100))
        k = first_at(ready, s + 1, until)
        if k >= n:
            continue
        entry, end = close[k], k + r.horizon
        stop, target = entry * (1 - r.stop_pct / 100), entry * (1 + (r.target_pct or 0.0) / 100)
        exits = [(first_at(low <= stop, k + 1, n), 0, "STOP", stop)]
        if r.target_pct is not None:
            exits.append((first_at(high >= target, k + 1, n), 1, "TARGET", target))
        if r.trail:
            t = first_at(close < line, k + max(1, r.trail_after), n)
            exits.append((t, 2, "TRAIL", close[t] if t < n else 0.0))
        exits.append((end if end < n else 1 << 30, 3, "TIME", close[end] if end < n else 0.0))
        x, _, kind, price = min(exits)
        if x >= n:
            x, kind, price = n - 1, "OPEN", close[n - 1]
        ret = (price * (1 - cost) / (entry * (1 + cost)) - 1) * 100
        out.append((r.name, int(pdf["instrument"].iloc[0]), day[s], day[k], entry, day[x], price, kind, ret, float(pdf["score"].iloc[s]), x - k))
        free = n if kind == "OPEN" else x + 1
    return out


def watched() -> list[Column]:
    """What trades read of a bar beside its prices: the mean volume of the 50 bars before, and the mean close of 50."""
    prior, last = by_day().rowsBetween(-50, -1), by_day().rowsBetween(-49, 0)
    return [F.when(F.count("volume").over(prior) == 50, F.avg("volume").over(prior)).alias("base"), F.when(F.count("close").over(last) == 50, F.avg("close").over(last)).alias("line")]


def watched_columns(f: Frames) -> None:
    """watched() as frames."""
    f.put("base", f.lag(f.mean(f["volume"], 50, every=True), 1))
    f.put("line", f.mean(f["close"], 50, every=True))


def run_trades(bars: DataFrame, signals: DataFrame, rules: list[TradeRule]) -> DataFrame:
    """Trades of every rule on every instrument. signals: (instrument, trade_date, level, score), one per bar at most.

    An instrument's bars go to Python once, for all rules, and only where it has a signal; signals meet them there, so bars are not dealt out
    by day for it.
    """
    rows = bars.join(signals.select("instrument").distinct(), "instrument", "left_semi")
    rows = rows.select("instrument", "trade_date", "high", "low", "close", "volume", *watched())
    # Columns of their own, as signals may be made of the same bars.
    own = signals.where("instrument IS NOT NULL AND trade_date IS NOT NULL").select(*[F.col(c).alias(c) for c in ("instrument", "trade_date")], *[F.col(c).cast("double").alias(c) for c in ("level", "score")])

    def run(bars: pd.DataFrame, signals: pd.DataFrame) -> pd.DataFrame:
        return all_trades(bars.merge(signals.drop(columns="instrument"), "left", "trade_date"), rules)

    return rows.groupBy("instrument").cogroup(own.groupBy("instrument")).applyInPandas(run, TRADE)


def screened_trades(rows: DataFrame, rules: list[TradeRule]) -> DataFrame:
    """run_trades of bars that carry status, rs_rank and level beside watched(): their fresh ones are the signals, so nothing is computed twice or joined."""
    rows = rows.where("instrument IS NOT NULL").withColumn("_fresh", is_fresh()).withColumn("_any", F.max("_fresh").over(W.partitionBy("instrument"))).where("_any")
    own = [F.when(F.col("_fresh"), F.col(c).cast("double")).alias(n) for c, n in (("level", "level"), ("rs_rank", "score"))]
    return trades_on(rows.select("instrument", "trade_date", "high", "low", "close", "volume", "base", "line", *own), rules)


def trades_on(rows: DataFrame, rules: list[TradeRule]) -> DataFrame:
    """Trades of every rule on bars(instrument, trade_date, high, low, close, volume, and watched()) that carry level and score where they are signals."""

    return rows.groupBy("instrument").applyInPandas(lambda pdf: all_trades(pdf, rules), TRADE)


def all_trades(pdf: pd.DataFrame, rules: list[TradeRule]) -> pd.DataFrame:
    """TRADE rows of every rule on one instrument."""
    pdf = pdf.sort_values("trade_date", ignore_index=True).rename(columns={"line": "sma_50"})
    return pd.DataFrame([t for r in rules if len(pdf) for t in trades_of(pdf, r)], columns=[c.split()[0] for c in TRADE.split(", ")])


def contenders(trades: DataFrame, bars: DataFrame, slots: int) -> DataFrame:
    """Those of trades that could be taken: per rule and entry day the first `slots` by score, then instrument, with a bar that day."""
    there = bars.select("instrument", F.col("trade_date").alias("entry_date"))
    best = W.partitionBy("rule", "entry_date").orderBy(F.desc_nulls_last(F.nanvl("score", F.lit(None).cast("double"))), "instrument")
    return trades.join(there, ["instrument", "entry_date"], "left_semi").withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= slots).drop("_k")


def held_days(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """(rule, instrument, trade_date, ...): the bars on which each trade is held."""
    return trades.join(bars.select("instrument", "trade_date", "close"), "instrument").where((F.col("trade_date") >= F.col("entry_date")) & (F.col("trade_date") <= F.col("exit_date")))


def portfolio(trades: DataFrame, bars: DataFrame, slots: int = 10) -> DataFrame:
    """(rule, day, value, cash, n_open, n_taken): the days of portfolio_days()."""
    return portfolio_days(trades, bars, slots).drop("taken")


def taken_trades(trades: DataFrame, bars: DataFrame, slots: int = 10) -> DataFrame:
    """(rule, instrument, entry_date): the trades that found a slot."""
    return portfolio_days(trades, bars, slots).select("rule", F.explode("taken").alias("instrument"), F.col("day").alias("entry_date"))


def portfolio_days(trades: DataFrame, bars: DataFrame, slots: int = 10) -> DataFrame:
    """Per rule: daily value, cash and open positions with a fixed number of slots, exits before entries, higher scores first.

    A day's fold needs the day before, so one scenario is one group. It gets the held days of at most `slots` trades of each entry
    day, since no more can open, and one row for each day on which any trade is held; so it doesn't grow with the market.
    """
    columns = ["rule", "instrument", "entry_date", "exit_date", "entry", "exit", "exit_kind", "score", "trade_date", "close"]
    rows = held_days(contenders(trades, bars, slots), bars).select(*columns, F.lit(True).alias("held"))
    days = held_days(trades, bars).select("rule", "trade_date").distinct().withColumns({"instrument": F.lit(0).cast("long"), "held": F.lit(False)})
    rows = rows.unionByName(days, allowMissingColumns=True)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        cost, cash, shares, out, marks = 0.0015, 1.0, {}, [], {}
        for day, group in pdf.sort_values(["trade_date", "score", "instrument"], ascending=[True, False, True]).groupby("trade_date", sort=True):
            group, taken = group[group["held"]], []
            for t in group.itertuples():
                key = (t.instrument, t.entry_date)
                marks[key] = t.close
                if t.exit_date == day and t.exit_kind != "OPEN" and key in shares:
                    cash += shares.pop(key) * t.exit * (1 - cost)
            value = cash + sum(n * marks[k] for k, n in shares.items())
            for t in group.itertuples():
                if t.entry_date == day and len(shares) < slots and (size := min(value / slots, cash)) > 0:
                    shares[t.instrument, t.entry_date] = size / (t.entry * (1 + cost))
                    cash -= size
                    taken.append(int(t.instrument))
            out.append((pdf["rule"].iloc[0], day, cash + sum(n * marks[k] for k, n in shares.items()), cash, len(shares), len(taken), taken))
        return pd.DataFrame(out, columns=["rule", "day", "value", "cash", "n_open", "n_taken", "taken"])

    return rows.groupBy("rule").applyInPandas(fold, "rule string, day date, value double, cash double, n_open int, n_taken int, taken array<long>")


def is_fresh(quiet: int = 10) -> Column:
    """Whether a bar passes the screen, by its status, as the first one after `quiet` bars without a pass."""
    passed = F.when(F.col("status") == "PASS", 1).otherwise(0)
    before = F.sum(passed).over(by_day().rowsBetween(-quiet, -1))
    return F.coalesce((F.col("status") == "PASS") & (before == 0) & F.col("instrument").isNotNull() & F.col("trade_date").isNotNull(), F.lit(False))


def fresh(status: DataFrame, quiet: int = 10) -> DataFrame:
    """Rows of status(instrument, trade_date, status, ...) that are fresh. Rows without a key are none."""
    return status.withColumn("_fresh", is_fresh(quiet)).where("_fresh").drop("_fresh")


def fresh_signals(status: DataFrame, level: DataFrame, quiet: int = 10) -> DataFrame:
    """fresh() bars of the screen; level(instrument, trade_date, level) is the price to break, score the strength rank."""
    return fresh(status, quiet).join(level, ["instrument", "trade_date"]).select("instrument", "trade_date", "level", F.col("rs_rank").cast("double").alias("score"))
