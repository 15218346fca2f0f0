"""Base patterns as of a day: the highest confirmed swing high of a stretch of bars and the contractions behind it.

Swings are columns, from windows over the instrument's bars. Bases and their legs follow from them for all bars of a few
instruments at once, in numpy; measures and classes are columns again. Nothing after a bar is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import asof
from barloom.operators.features import by_day
from barloom.operators.frames import Frames
from barloom.operators.runs import Extremes, by_instrument, firsts, lists, picked, spread


@dataclass(frozen=True)
class BaseRules:
    left: int = 5
    right: int = 5
    window: int = 130
    advance_bars: int = 120
    advance_pct: float = 20.0
    noise_pct: float = 2.0
    short_bars: int = 3
    short_pct: float = 4.0
    equal_pct: float = 1.5


def known_swings(bars: DataFrame, rules: BaseRules, asked: Column) -> DataFrame:
    """(instrument, trade_date, high, low, n, before, is_high, is_low, low_tail, asked): bars with their swings, which are known `right` bars later.

    before is the lowest low of the advance_bars that end with a bar's own, low_tail that of the bars too young to be swings. A
    price that is no number is missing.
    """
    w = by_day()
    around, run_up = w.rowsBetween(-rules.left, rules.right), w.rowsBetween(-(rules.advance_bars - 1), 0)
    rows = bars.select("instrument", "trade_date", *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in ("high", "low")])
    inside = (F.row_number().over(w) > rules.left) & F.lead("low", rules.right).over(w).isNotNull()
    swing = lambda c, extreme: F.coalesce(inside & (F.col(c) == extreme(c).over(around)), F.lit(False))
    return rows.select(
        "*", F.row_number().over(w).alias("n"), F.min("low").over(run_up).alias("before"), swing("high", F.max).alias("is_high"), swing("low", F.min).alias("is_low"),
        F.min("low").over(w.rowsBetween(-(rules.right - 1), 0)).alias("low_tail"), F.coalesce(asked, F.lit(False)).alias("asked"),
    )


CONTRACTION = "struct<peak_date: date, peak: double, trough_date: date, trough: double, depth_pct: double, confirmed: boolean>"
REASONS = (None, "NO_SWING_HIGH", "INSUFFICIENT_HISTORY", "NO_ADVANCE")


class Contractions:
    """The contractions of many bases at once, a row each: a leg that is noise, and one that starts within equal_pct of the leg before or above it, is part of the leg before."""

    def __init__(self, rows: int, rules: BaseRules):
        self.rules, self.n = rules, np.zeros(rows, int)
        self.parts = {"peak_at": np.zeros((rows, 4), int), "peak": np.zeros((rows, 4)), "at": np.zeros((rows, 4), int), "trough": np.zeros((rows, 4)), "confirmed": np.zeros((rows, 4), np.int8)}

    def room(self, slots: int) -> None:
        more = slots - self.parts["peak"].shape[1]
        if more > 0:
            self.parts = {c: np.pad(v, ((0, 0), (0, more + 3))) for c, v in self.parts.items()}

    def take(self, rows: np.ndarray, other: Contractions, at: np.ndarray) -> None:
        """Other's rows become these rows."""
        self.room(other.parts["peak"].shape[1])
        self.n[rows] = other.n[at]
        for c, v in self.parts.items():
            v[rows, : other.parts[c].shape[1]] = other.parts[c][at]

    def add(self, rows: np.ndarray, **leg: np.ndarray) -> None:
        """Takes a leg each, but where its trough is missing or not under its peak."""
        some = leg["trough"] < leg["peak"]
        rows, leg = rows[some], {c: v[some] for c, v in leg.items()}
        n, r = self.n[rows], self.rules
        last = {c: self.parts[c][rows, n - 1] for c in ("peak", "trough")}
        depth = (1 - leg["trough"] / leg["peak"]) * 100
        shallow = (depth < r.noise_pct) | ((leg["at"] - leg["peak_at"] < r.short_bars) & (depth < r.short_pct))
        part = (n > 0) & (shallow | (leg["peak"] >= last["peak"] * (1 - r.equal_pct / 100)))
        lower = part & (leg["trough"] < last["trough"])
        for c in ("at", "trough", "confirmed"):
            self.parts[c][rows[lower], n[lower] - 1] = leg[c][lower]
        self.room(int(n.max(initial=0)) + 1)
        for c, v in self.parts.items():
            v[rows[~part], n[~part]] = leg[c][~part]
        self.n[rows[~part]] += 1


def bases_of(table: pa.Table, r: BaseRules, names: list[str]) -> pa.Table:
    """Bases as of each asked bar of whole instruments, bars in order: those with one highest swing take their next leg at once, and a bar copies the legs when they reach its last swing high."""
    first, n, every = firsts(table), table["n"].to_numpy(), np.arange(table.num_rows)
    day, high, low, before, tail = (table[c].to_numpy() for c in ("trade_date", "high", "low", "before", "low_tail"))
    is_high, is_low = table["is_high"].to_numpy(), table["is_low"].to_numpy()
    tops, lows = Extremes(np.where(is_high, high, -np.inf), r.window), Extremes(np.where(is_low, low, np.inf), r.window, lowest=True)
    swings, count = np.flatnonzero(is_high), np.concatenate([[0], np.cumsum(is_high)])

    edge, known = np.maximum(first, every - r.window + 1), every - r.right + 1
    rows = np.flatnonzero(known > edge)
    top = tops.place(edge[rows], known[rows])
    there = is_high[top]
    rows, top = rows[there], top[there]
    known = known[rows]

    def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and prices of the lowest swing lows in a .. b-1, NaN for none."""
        at, price, some = np.zeros(len(a), int), np.full(len(a), np.nan), np.flatnonzero(b > a)
        at[some] = lows.place(a[some], b[some])
        price[some] = np.where(is_low[at[some]], low[at[some]], np.nan)
        return at, price

    begins, of = np.unique(top, return_inverse=True)
    rank = count[begins]
    steps = count[known] - rank[of] - 1
    most = np.zeros(len(begins), int)
    np.maximum.at(most, of, steps)
    bases, found = Contractions(len(begins), r), Contractions(len(rows), r)
    by_step = np.argsort(steps, kind="stable")
    edges = np.searchsorted(steps[by_step], np.arange(steps.max(initial=-1) + 2))
    for k in range(len(edges) - 1):
        those = by_step[edges[k] : edges[k + 1]]
        found.take(those, bases, of[those])
        on = np.flatnonzero(most > k)
        peak = swings[rank[on] + k]
        at, trough = lowest(peak + 1, swings[rank[on] + k + 1] + 1)
        bases.add(on, peak_at=peak, peak=high[peak], at=at, trough=trough, confirmed=np.ones(len(on), np.int8))
    # The last leg may end in low_tail and is unconfirmed then; whether it does is unknown (2) where all of the tail is missing.
    peak = swings[rank[of] + steps]
    at, trough = lowest(peak + 1, known)
    young = np.isnan(trough) | (tail[rows] < trough)
    confirmed = np.where(young, 0, np.where(np.isnan(tail[rows]), 2, 1)).astype(np.int8)
    found.add(np.arange(len(rows)), peak_at=peak, peak=high[peak], at=np.where(young, rows, at), trough=np.where(young, tail[rows], trough), confirmed=confirmed)

    bottom = np.fmin(lowest(top, known)[1], tail[rows])
    advance = (high[top] / before[top] - 1) * 100
    reason = np.ones(len(every), int)
    reason[rows] = np.where(advance < r.advance_pct, np.where(n[top] < r.advance_bars, 2, 3), 0)
    row, slot = np.nonzero(np.arange(found.parts["peak"].shape[1]) < found.n[:, None])
    leg = {c: v[row, slot] for c, v in found.parts.items()}
    date = lambda at: pa.array(day[at], pa.date32())
    record = pa.StructArray.from_arrays(
        [date(leg["peak_at"]), pa.array(leg["peak"]), date(leg["at"]), pa.array(leg["trough"]), pa.array((1 - leg["trough"] / leg["peak"]) * 100), pa.array(leg["confirmed"] == 1, mask=leg["confirmed"] == 2)],
        names=["peak_date", "peak", "trough_date", "trough", "depth_pct", "confirmed"],
    )
    legs, bars = np.zeros(len(every), int), np.zeros(len(every), np.int32)
    legs[rows], bars[rows] = found.n, n[rows] - n[top]
    number = lambda x: spread(x, rows, len(every), pa.float64())
    columns = [
        table["instrument"], table["trade_date"], spread(day[top], rows, len(every), pa.date32()), number(high[top]), number(bottom), number((1 - bottom / high[top]) * 100), pa.array(bars), number(advance), picked(REASONS, reason),
        lists(record, legs, every, len(every)),
    ]
    return pa.table(columns, names=names).filter(table["asked"])


def of_days(rows: DataFrame, as_of: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Those of rows(instrument, trade_date, ...) at the last bar on or before each as_of(instrument, as_of) day, with as_of; days has the rows' days, if they are dear to compute."""
    last = asof.backward(as_of.select("instrument", "as_of"), (rows if days is None else days).select("instrument", "trade_date", F.lit(True).alias("there")), ["instrument"], "as_of", "trade_date", ["there"])
    at = last.where("there").select("instrument", F.col("matched_trade_date").alias("trade_date"), "as_of")
    return rows.join(at, ["instrument", "trade_date"])


def detect_bases(bars: DataFrame, as_of: DataFrame | None = None, rules: BaseRules = BaseRules(), asked: Column | None = None) -> DataFrame:
    """The base of each instrument and day of as_of(instrument, as_of), or of each bar; a day before the first bar has no row.

    asked tells the bars to answer for, by their trade_date and windows by_day(), so that the others' bases are never made or moved.

    (instrument, as_of, base_start, base_high, base_low, depth_pct, n_bars, advance_pct, reason, contractions). reason says why there is
    no base: NO_SWING_HIGH, INSUFFICIENT_HISTORY, NO_ADVANCE; null if there is one. Legs go from each swing high to the lowest swing low before
    the next one, the last one to the lowest low; one without a low behind it gives way to the next. A leg that is noise, and one that starts within equal_pct
    of the leg before or above it, is part of the leg before.
    """
    kinds = {"instrument": bars.schema["instrument"].dataType.simpleString(), "trade_date": "date", "base_start": "date", "base_high": "double", "base_low": "double", "depth_pct": "double", "n_bars": "int", "advance_pct": "double", "reason": "string", "contractions": f"array<{CONTRACTION}>"}
    found = by_instrument(known_swings(bars, rules, F.lit(True) if asked is None else asked), lambda table: bases_of(table, rules, list(kinds)), ", ".join(f"{c} {t}" for c, t in kinds.items()))
    if as_of is None:
        return found.withColumnRenamed("trade_date", "as_of")
    return of_days(found, as_of, bars).select("instrument", "as_of", *list(kinds)[2:])


def measures(bases: DataFrame) -> DataFrame:
    """How a base tightens: each contraction's depth beside the one before, and whether they shrink one after the other.

    (instrument, as_of, n, first_depth, last_depth, mean_ratio, worst_ratio, progressive, shrinking_share); ratios are null below two.
    """
    d = F.transform("contractions", lambda c: c["depth_pct"])
    ratios = F.filter(F.transform(d, lambda x, i: x / F.get(d, i - 1)), lambda r: r.isNotNull())
    rows = bases.select("instrument", "as_of", d.alias("d"), ratios.alias("r")).withColumn("k", F.size("r"))
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "instrument", "as_of", F.size("d").alias("n"), F.get("d", 0).alias("first_depth"), F.try_element_at("d", F.lit(-1)).alias("last_depth"),
        F.when(F.col("k") > 0, total / F.col("k")).alias("mean_ratio"), F.array_max("r").alias("worst_ratio"),
        F.when(F.col("k") > 0, F.forall("r", lambda x: x < 1)).alias("progressive"), F.when(F.col("k") > 0, F.size(F.filter("r", lambda x: x < 1)) / F.col("k")).alias("shrinking_share"),
    )


def new_signals(candidates: DataFrame, rearm: int = 20, tolerance_pct: float = 0.01) -> DataFrame:
    """Candidate days(instrument, as_of, pivot, session) that start something new.

    A day is new if the session before was no candidate, the pivot is not within tolerance_pct of the last signal's, or rearm sessions
    have passed since it. Which signal was last depends on the days before, so the days of one run without a gap are folded in
    order; a run is at most as long as the instrument's passing sessions in a row.
    """
    w = W.partitionBy("instrument").orderBy("session")
    rows = candidates.withColumn("gap", F.coalesce(F.col("session") - F.lag("session").over(w) != 1, F.lit(True)).cast("int")).withColumn("run", F.sum("gap").over(w))
    runs = rows.groupBy("instrument", "run").agg(F.array_sort(F.collect_list(F.struct("session", "as_of", "pivot"))).alias("days"))

    def take(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        moved = F.abs(x["pivot"] / last["pivot"] - 1) * 100 > tolerance_pct
        return F.when(last.isNull() | moved | (x["session"] - last["session"] >= rearm), F.concat(a, F.array(x))).otherwise(a)

    signals = runs.select("instrument", F.inline(F.aggregate("days", F.slice("days", 1, 0), take)))
    return signals.select("instrument", "as_of", "pivot")


def tiers(bases: DataFrame) -> DataFrame:
    """Class of each base with the rules it misses: A_PLUS, FULL, LIKE or NONE, and its tightening ratios."""
    depths = F.transform("contractions", lambda c: c["depth_pct"])
    ratios = F.transform(F.sequence(F.lit(1), F.greatest(F.size("contractions") - 1, F.lit(1))), lambda i: F.get("d", i) / F.get("d", i - 1))
    rows = bases.withColumn("d", depths).withColumn("ratios", F.array_compact(ratios))
    n, final = F.size("d"), F.try_element_at("d", F.lit(-1))
    progressive = F.forall("ratios", lambda r: r < 1)
    unmet = lambda k, depth, last: F.array_compact(F.array(F.when(n < k, F.lit("CONTRACTIONS")), F.when(~progressive, F.lit("TIGHTENING")), F.when(F.col("depth_pct") > depth, F.lit("DEPTH")), F.when(F.coalesce(final, F.lit(100.0)) > last, F.lit("FINAL"))))
    rows = rows.withColumn("unmet_a", unmet(3, 25.0, 6.0)).withColumn("unmet_full", unmet(2, 35.0, 10.0)).withColumn("unmet_like", unmet(2, 50.0, 15.0))
    cls = F.when(F.col("reason").isNotNull(), "NONE").when(F.size("unmet_a") == 0, "A_PLUS").when(F.size("unmet_full") == 0, "FULL").when(F.size("unmet_like") == 0, "LIKE").otherwise("NONE")
    return rows.select("instrument", "as_of", "reason", n.alias("n_contractions"), "depth_pct", "ratios", cls.alias("class"), F.concat_ws(",", "unmet_full").alias("unmet"))


def stands(table: pa.Table, volume_ratio: float, names: list[str]) -> pa.Table:
    """Where bases stand on the last bar up to their day: the lowest low up to the level's day, the close, the first loud close above the level behind that day.

    Rows with legs are bases, the others bars, of whole instruments.
    """
    of = pc.dictionary_encode(table["instrument"].combine_chunks()).indices.to_numpy().astype(np.int64) << 32
    key = lambda c: of + np.nan_to_num(table[c].combine_chunks().cast(pa.int32()).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-(1 << 31)).astype(np.int64)
    is_base = table["legs"].is_valid().to_numpy()
    at, k, day = key("trade_date")[~is_base], np.flatnonzero(is_base), table["trade_date"]
    bars, bases = table.filter(pa.array(~is_base)), table.take(pa.array(k))
    f = Frames(bars)
    (low, has_low), (close, has_close), volume = f["low"], f["close"], f["volume"]
    mean, there = f.lag(f.mean(volume, 50, every=True), 1)
    # A NaN is above all numbers.
    ratio = np.where(there & volume[1] & ~(mean <= 0), np.nan_to_num(volume[0] / mean, nan=np.inf), -np.inf)
    loud = Extremes(np.where(has_close & (ratio >= volume_ratio), np.nan_to_num(close, nan=np.inf), -np.inf), len(at))
    lows, seen = Extremes(np.where(has_low, np.nan_to_num(low, nan=np.inf), np.inf), len(at), lowest=True), np.concatenate([[0], np.cumsum(has_low)])

    starts, levels = key("base_start")[k], key("level_date")[k]
    first, last, behind = np.searchsorted(at, starts), np.searchsorted(at, key("trade_date")[k], "right") - 1, np.searchsorted(at, levels, "right")
    some = np.flatnonzero((last >= first) & (at[np.minimum(first, len(at) - 1)] == starts)) if len(at) else np.zeros(0, int)
    first, last, behind = first[some], last[some], np.maximum(behind[some], first[some])
    until = np.minimum(behind, last + 1)
    floor, full = np.full(len(some), np.nan), np.flatnonzero(seen[until] > seen[first])
    floor[full] = low[lows.place(first[full], until[full])]
    level = bases["level"].combine_chunks().take(pa.array(some))
    broke = loud.first(until, last + 1, level.to_numpy(zero_copy_only=False), strictly=True) if len(some) else last
    days = bars["trade_date"].combine_chunks()
    columns = [
        bases["instrument"].take(pa.array(some)), day.take(pa.array(k[some])), bases["legs"].take(pa.array(some)), level, pa.array(floor, mask=seen[until] <= seen[first]), bars["close"].take(pa.array(last)),
        days.take(pa.array(broke, mask=broke > last)), days.take(pa.array(last)),
    ]
    return pa.table(columns, names=names)


def base_status(bases: DataFrame, bars: DataFrame, trend: DataFrame, volume_ratio: float = 1.5, break_pct: float = 0.0, ready_pct: float = 5.0) -> DataFrame:
    """Status of each base by precedence: INVALIDATED, BREAKOUT or FAILED, READY, FORMING.

    The level is the last contraction's peak, or the base's high. A base of two contractions or more is invalid once the close is
    under its low before the last peak, any base once its instrument fails the trend screen. A breakout is the first close above the
    level behind its day with volume_ratio times the mean volume of 50 bars before; it has failed if the close is under the level.
    """
    last = F.try_element_at("contractions", F.lit(-1))
    k = bases.where("reason IS NULL").select("instrument", F.col("as_of").alias("trade_date"), "base_start", F.size("contractions").alias("legs"), F.coalesce(last["peak"], F.col("base_high")).alias("level"), F.coalesce(last["peak_date"], F.col("base_start")).alias("level_date"))
    # Bases come to their instruments' bars, so both are dealt out once and no base is spread over its bars.
    asked = k.unionByName(bars.select("instrument", "trade_date", "low", "close", "volume"), allowMissingColumns=True).where("instrument IS NOT NULL").repartition("instrument")
    kinds = {"instrument": bars.schema["instrument"].dataType.simpleString(), "as_of": "date", "legs": "int", "level": "double", "floor": "double", "close": "double", "breakout_on": "date", "trade_date": "date"}
    rows = by_instrument(asked, lambda table: stands(table, volume_ratio, list(kinds)), ", ".join(f"{c} {t}" for c, t in kinds.items()))
    rows = rows.join(trend.select("instrument", "trade_date", "status"), ["instrument", "trade_date"], "left").withColumnRenamed("status", "trend")
    reasons = F.array_compact(F.array(F.when(F.col("trend") == "FAIL", F.lit("TREND")), F.when((F.col("legs") >= 2) & (F.col("close") < F.col("floor") * (1 - break_pct / 100)), F.lit("BASE_LOW"))))
    below = (F.col("level") / F.col("close") - 1) * 100
    state = F.when(F.size("reasons") > 0, "INVALIDATED").when(F.col("breakout_on").isNotNull(), F.when(F.col("close") >= F.col("level"), "BREAKOUT").otherwise("FAILED")).when((F.col("legs") >= 2) & below.between(0, ready_pct), "READY").otherwise("FORMING")
    return rows.withColumn("reasons", reasons).select("instrument", "as_of", "level", "breakout_on", F.concat_ws(",", "reasons").alias("reasons"), state.alias("state"))


def status_history(states: DataFrame) -> DataFrame:
    """Rows of base_status on which an instrument's state is not that of its row before."""
    before = F.lag("state").over(W.partitionBy("instrument").orderBy("as_of"))
    return states.withColumn("before", before).where(~F.col("state").eqNullSafe(F.col("before"))).select("instrument", "as_of", "before", "state")
