"""Frames of rows around every bar, for all bars of a share of whole instruments at once.

A window of Spark's goes through its whole frame anew on each bar. Here each step of a frame is taken for all bars together, in
the order in which the window takes it, so sums are equal to its sums in every bit.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.runs import by_instrument, firsts

BAR = ("instrument", "trade_date", "open", "high", "low", "close", "volume")
KINDS = {pa.float64(): "double", pa.int64(): "long", pa.date32(): "date"}
#: Values, zero where there is none, and whether there is one.
Numbers = tuple[np.ndarray, np.ndarray]


def each(fn: Callable, *xs: Numbers) -> Numbers:
    """fn of numbers, null where one of them is."""
    return fn(*[v for v, _ in xs]), np.logical_and.reduce([ok for _, ok in xs])


def ratio(a: Numbers, b: Numbers) -> Numbers:
    """a / b, null where b is null or zero."""
    return each(np.divide, a, (b[0], b[1] & (b[0] != 0)))


def greatest(*xs: Numbers) -> Numbers:
    """The greatest of those that are there; a NaN is above all."""
    return np.maximum.reduce([np.where(ok, v, -np.inf) for v, ok in xs]), np.logical_or.reduce([ok for _, ok in xs])


def finite(x: Numbers) -> Numbers:
    return x[0], x[1] & np.isfinite(x[0])


class Frames:
    """A table of BAR columns of whole instruments in order, and the columns put to it.

    A frame of n rows ends with the row itself and is null until there are so many of the instrument.
    """

    def __init__(self, table: pa.Table):
        self.table, self.put_columns, self.numbers = table, {}, {}
        first = firsts(table)
        self.before = np.arange(len(first)) - first
        self.after = np.bincount(first, minlength=len(first))[first] - 1 - self.before

    def __getitem__(self, name: str) -> Numbers:
        if name not in self.numbers:
            column = self.table[name].combine_chunks().cast(pa.float64())
            self.numbers[name] = column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
        return self.numbers[name]

    def put(self, name: str, x: Numbers) -> Numbers:
        self.put_columns[name] = pa.array(x[0], mask=~x[1], from_pandas=False)
        self.numbers[name] = x
        return x

    def lag(self, x: Numbers, k: int) -> Numbers:
        """The number k rows before; below zero, of rows after."""
        there = self.before >= k if k > 0 else self.after >= -k
        at = np.where(there, np.arange(len(there)) - k, 0)
        return x[0][at], x[1][at] & there

    def put_day(self, name: str, k: int) -> None:
        """trade_date k rows before; below zero, of rows after."""
        there = self.before >= k if k > 0 else self.after >= -k
        self.put_columns[name] = self.table["trade_date"].combine_chunks().take(pa.array(np.arange(len(there)) - k, mask=~there))

    def count(self, x: Numbers, n: int) -> np.ndarray:
        """How many of n rows have a value, where there are n rows."""
        out, upto = np.zeros(len(x[1]), np.int64), np.concatenate([[0], np.cumsum(x[1])])
        out[n - 1 :] = upto[n:] - upto[:-n]
        return out

    def whole(self, x: Numbers, n: int, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether the frame is full): every asks for a value in each row, else one will do."""
        seen = self.count(x, n)
        return seen, (self.before >= n - 1) & (seen == n if every else seen > 0)

    def mean(self, x: Numbers, n: int, every: bool = False) -> Numbers:
        seen, there = self.whole(x, n, every)
        v, rest = np.where(x[1], x[0], 0.0), len(seen) - n + 1
        total = np.zeros(len(v))
        for k in range(n if rest > 0 else 0):
            total[n - 1 :] += v[k : k + rest]
        return total / np.maximum(seen, 1), there

    def deviation(self, x: Numbers, n: int) -> Numbers:
        """Deviation of the population, where each row has a value; mean and squares are carried from row to row."""
        seen, there = self.whole(x, n, every=True)
        v, rest = np.where(x[1], x[0], 0.0), max(0, len(seen) - n + 1)
        mean, squares, out = np.zeros(rest), np.zeros(rest), np.zeros(len(v))
        for k in range(n if rest else 0):
            delta = v[k : k + rest] - mean
            step = delta / (k + 1.0)
            mean += step
            squares += delta * (delta - step)
        out[n - 1 :] = np.sqrt(squares / n)
        return out, there

    def extreme(self, x: Numbers, n: int, lowest: bool = False) -> Numbers:
        """A NaN is above all numbers. Frames of 2^k rows are made of two of half as many, that of n of two that overlap."""
        of, best, held = np.fmin if lowest else np.maximum, np.where(x[1], x[0], np.nan if lowest else -np.inf), 1
        while held < n:
            step = min(held, n - held)
            best[step:] = of(best[step:], best[:-step])
            held += step
        return best, self.whole(x, n)[1]

    def ahead(self, x: Numbers, n: int) -> tuple[Numbers, Numbers]:
        """(lowest, count) of the n rows after a row, or of those there are."""
        lowest, seen = np.full(len(x[0]), np.nan), np.zeros(len(x[0]), np.int64)
        for k in range(1, n + 1):
            v, ok = self.lag(x, -k)
            lowest = np.fmin(lowest, np.where(ok, v, np.nan))
            seen += ok
        return (lowest, seen > 0), (seen, np.ones(len(seen), bool))


Maker = Callable[[Frames], None]


def framed(table: pa.Table, makers: tuple[Maker, ...], since: date | None = None) -> pa.Table:
    """BAR columns and those that makers put, of rows from `since` on."""
    f = Frames(table)
    for make in makers:
        make(f)
    out = pa.table({**{c: table[c] for c in BAR}, **f.put_columns})
    return out if since is None else out.filter(pc.greater_equal(table["trade_date"], pa.scalar(since, pa.date32())))


def with_frames(bars: DataFrame, *makers: Maker, since: date | None = None) -> DataFrame:
    """Bars with the columns that makers put, in one pass over each instrument's bars; rows before `since` are only read."""
    blank = pa.table({c: pa.array([0], pa.int64()) if c == "instrument" else pa.nulls(1, pa.date32() if c == "trade_date" else pa.float64()) for c in BAR})
    with np.errstate(all="ignore"):
        made = framed(blank, makers).schema
    kinds = [f"{c} {bars.schema[c].dataType.simpleString()}" for c in BAR] + [f"{c.name} {KINDS[c.type]}" for c in list(made)[len(BAR) :]]
    # The number brings an instrument's bars together and in order.
    rows = bars.select(*BAR, F.row_number().over(W.partitionBy("instrument").orderBy("trade_date")).alias("n"))
    return by_instrument(rows, lambda table: framed(table, makers, since), ", ".join(kinds))
