"""Levels of a base that a breakout may be measured against, and how often the market has visited each.

Bases meet the bars of their instrument in a share of whole instruments, where the levels of many bases are found at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.runs import Extremes, by_instrument, firsts, picked

@dataclass(frozen=True)
class PivotRules:
    """The published settings."""

    left: int = 5
    right: int = 5
    #: Highs within so many percent are one level, and the zone under a level is as wide.
    level_pct: float = 1.5
    right_side: int = 10
    tight_pct: float = 5.0


#: Sources of a level; of equal ones the first in this order names it. Fixed values.
SOURCES = ("BASE_HIGH", "LAST_PEAK", "RIGHT_SIDE_HIGH", "REPEATED")
#: Bars of levels that are looked at together, unless one base has more.
HELD = 2_000_000


def pivots(bars: DataFrame, bases: DataFrame, rules: PivotRules = PivotRules()) -> DataFrame:
    """Levels of each base as of its as_of day: (instrument, base_start, as_of, source, pivot, pivot_date, distance_pct, touches, rejections, tightness_pct, is_primary, is_structural).

    Levels are the base's first high, the last swing high behind it, the highest high of the last right_side bars (the latest
    of equals), and each top that two swing highs or more form. A visit is a run of bars whose highs reach the level's zone; it
    is a rejection if it ended before as_of without a close above the level. Structural is the last peak, or the first
    high where there is none; primary is the right side's high if the right side is tight and the close not above it, else
    the structural one. A base whose days are no bars of its instrument, or that ends before it starts, has no row; prices that
    are null or no number reach nothing.
    """
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    prices = bars.select("instrument", "trade_date", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")], *nothing("date", "base_start"))
    asked = bases.dropna(subset=["instrument", "base_start", "as_of"]).select("instrument", F.col("as_of").alias("trade_date"), *nothing("double", "high", "low", "close"), "base_start")
    kinds = {
        "instrument": bars.schema["instrument"].dataType.simpleString(), "base_start": "date", "as_of": "date", "source": "string", "pivot": "double", "pivot_date": "date", "distance_pct": "double", "touches": "long", "rejections": "long",
        "tightness_pct": "double", "is_primary": "boolean", "is_structural": "boolean",
    }
    return by_instrument(prices.unionByName(asked).repartition("instrument"), lambda table: pivots_of(table, rules, list(kinds)), ", ".join(f"{c} {t}" for c, t in kinds.items()))


def pivots_of(table: pa.Table, rules: PivotRules, names: list[str]) -> pa.Table:
    """The rows of pivots() of a table of bars and bases in order; a base stands on its as_of day and has a base_start."""
    start = table["base_start"].combine_chunks()
    is_base = start.is_valid().to_numpy(zero_copy_only=False)
    bars, asked = table.filter(pa.array(~is_base)), np.flatnonzero(is_base)
    of = firsts(table)
    days = lambda column: column.cast(pa.int32()).fill_null(-(2**31)).to_numpy(zero_copy_only=False).astype(np.int64) + 2**31
    key = lambda rows, day: (of[rows] << 32) + day[rows]
    day = days(table["trade_date"].combine_chunks())
    known = key(np.flatnonzero(~is_base), day)
    first_key, last_key = key(asked, days(start)), key(asked, day)
    first, last = np.searchsorted(known, first_key), np.searchsorted(known, last_key)
    there = np.flatnonzero((last < len(known)) & (first <= last))
    there = there[(known[first[there]] == first_key[there]) & (known[last[there]] == last_key[there])]
    spans = np.unique(np.stack([first[there], last[there]]), axis=1)
    view = Levels(bars, of[~is_base], rules)
    found = [view.of(spans[:, a:b]) for a, b in shares(view.weights(*spans))]
    return pa.concat_tables(found).rename_columns(names) if found else pa.table({c: [] for c in names})


def shares(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of places whose weights are HELD together at most, or of one place."""
    upto, a = np.cumsum(weights), 0
    while a < len(weights):
        b = max(a + 1, int(np.searchsorted(upto, HELD + (upto[a - 1] if a else 0), "right")))
        yield a, b
        a = b


def counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts of so many members: the part of each member, and its place within it."""
    part = np.repeat(np.arange(len(sizes)), sizes)
    return part, np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Levels:
    """Levels of many bases, each a range of places in a table of bars of whole instruments."""

    def __init__(self, bars: pa.Table, of: np.ndarray, rules: PivotRules):
        self.bars, self.rules = bars, rules
        number = lambda c: bars[c].combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)
        self.high, self.close = number("high"), number("close")
        n = np.arange(len(of))
        widest = max(rules.left + rules.right + 1, rules.right_side)
        self.top, self.bottom = np.nan_to_num(self.high, nan=-np.inf), np.nan_to_num(number("low"), nan=np.inf)
        self.highest, self.lowest = Extremes(self.top, widest), Extremes(self.bottom, widest, lowest=True)
        # From behind the earliest of equals is the latest.
        self.latest = Extremes(self.top[::-1].copy(), widest)
        begin, end = np.searchsorted(of, of, "left"), np.searchsorted(of, of, "right")
        around = self.top[self.highest.place(np.maximum(begin, n - rules.left), np.minimum(end, n + rules.right + 1))] if len(of) else self.top
        self.swings = np.flatnonzero((self.high >= around) & (n - begin >= rules.left))

    def swings_in(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of swings of each base: those confirmed by its last bar."""
        a = np.searchsorted(self.swings, first)
        return a, np.maximum(a, np.searchsorted(self.swings, last - self.rules.right, "right"))

    def weights(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Bars of a base by the levels it may have."""
        a, b = self.swings_in(first, last)
        return (last - first + 1) * (3 + (b - a) // 2)

    def repeated(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, place, price) of tops that several swings form: from the highest down, all within level_pct of a level's top are one; its place is the latest of them."""
        a, b = self.swings_in(first, last)
        base, k = counted(b - a)
        n = self.swings[a[base] + k]
        n = n[np.lexsort((n, -self.high[n], base))]
        price = self.high[n]
        level, top = np.zeros(len(n), np.int64), price.copy()
        begin = np.cumsum(b - a) - (b - a)
        # The k-th swings of all bases go together.
        for step in range(1, int((b - a).max(initial=0))):
            i = begin[b - a > step] + step
            near = price[i] >= top[i - 1] * (1 - self.rules.level_pct / 100)
            top[i] = np.where(near, top[i - 1], price[i])
            level[i] = level[i - 1] + ~near
        starts = np.flatnonzero(np.concatenate([[True], (base[1:] != base[:-1]) | (level[1:] != level[:-1])])) if len(n) else n
        several = np.diff(np.append(starts, len(n))) >= 2
        latest = np.maximum.reduceat(n, starts) if len(n) else n
        return base[starts[several]], latest[several], top[starts[several]]

    def of(self, spans: np.ndarray) -> pa.Table:
        """Rows of bases (first and last place)."""
        rules, (first, last) = self.rules, spans
        all_, high = np.arange(len(first)), self.high
        late = np.maximum(first, last - rules.right_side + 1)
        right = len(high) - 1 - self.latest.place(len(high) - 1 - last, len(high) - late)
        a, b = self.swings_in(first, last)
        peak = self.swings[np.maximum(b - 1, 0)] if len(self.swings) else first
        peaked = (b > a) & (peak > first)
        structural = np.where(peaked, peak, first)
        tight = ((1 - self.bottom[self.lowest.place(late, last + 1)] / self.top[right]) * 100 <= rules.tight_pct) & (high[right] >= self.close[last])
        primary = np.where(tight, right, structural)
        # Of the same place and price the first source names a level.
        base, at, pivot = (np.concatenate(p) for p in zip((all_, first, high[first]), (all_[peaked], peak[peaked], high[peak[peaked]]), (all_, right, high[right]), self.repeated(first, last), strict=True))
        source = np.repeat(np.arange(4), [len(all_), peaked.sum(), len(all_), len(base) - 2 * len(all_) - peaked.sum()])
        by = np.lexsort((source, pivot, at, base))
        base, at, pivot, source = base[by], at[by], pivot[by], source[by]
        same = (base[1:] == base[:-1]) & (at[1:] == at[:-1]) & ((pivot[1:] == pivot[:-1]) | np.isnan(pivot[1:]) & np.isnan(pivot[:-1]))
        kept = np.concatenate([[True], ~same])
        base, at, pivot, source = base[kept], at[kept], pivot[kept], source[kept]
        first, last, primary, structural = first[base], last[base], primary[base], structural[base]
        touches, rejections = self.visits(first, last, pivot)
        after = np.maximum(at + 1, last - rules.right_side + 1)
        some = np.flatnonzero(after <= last)
        tightness = np.full(len(at), np.nan)
        hi, lo = (x.values[x.place(after[some], last[some] + 1)] for x in (self.highest, self.lowest))
        tightness[some] = np.where(np.isinf(hi) | np.isinf(lo), np.nan, (1 - -lo / hi) * 100)
        day = lambda n: self.bars["trade_date"].combine_chunks().take(pa.array(n))
        number = lambda x: pa.array(x, mask=np.isnan(x))
        is_ = lambda n: pa.array((at == n) & (pivot == high[n]), mask=(at == n) & np.isnan(pivot))
        columns = [
            self.bars["instrument"].combine_chunks().take(pa.array(first)), day(first), day(last), picked(SOURCES, source), number(pivot), day(at), number((pivot / self.close[last] - 1) * 100), pa.array(touches), pa.array(rejections),
            number(tightness), is_(primary), is_(structural),
        ]
        return pa.table(columns, names=[str(k) for k in range(len(columns))])

    def visits(self, first: np.ndarray, last: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(visits, rejections) of each level."""
        level, k = counted(last - first + 1)
        n = first[level] + k
        inside = self.high[n] >= (pivot * (1 - self.rules.level_pct / 100))[level]
        over = np.concatenate([[0], np.cumsum(self.close[n] > pivot[level])])
        border = np.flatnonzero(k == 0)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        begins[border] = inside[border]
        ends[border[1:] - 1] = inside[border[1:] - 1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
        rejected = (over[ends + 1] == over[begins]) & (n[ends] < last[level[ends]])
        count = lambda of: np.bincount(of, minlength=len(first))
        return count(level[begins]), count(level[ends[rejected]])
