"""Whole instruments of sorted bars as flat arrays: what a task's numpy code asks of many bars at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


class Extremes:
    """Places of extremes in many ranges of an array at once, the earliest of equals; from places for each 2^k values."""

    def __init__(self, values: np.ndarray, widest: int, lowest: bool = False):
        self.values = -values if lowest else values
        width = np.arange(max(2, min(widest, len(values)) + 1))
        self.log = np.frexp(width)[1] - 1
        self.at = np.zeros((self.log[-1] + 1, len(values)), np.int32)
        self.at[0] = np.arange(len(values))
        for k in range(1, len(self.at)):
            half = 1 << k - 1
            a, b = self.at[k - 1, :-half], self.at[k - 1, half:]
            self.at[k, :-half] = np.where(self.values[a] >= self.values[b], a, b)

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the extreme of a .. b-1; ranges are not empty."""
        k = self.log[b - a]
        i, j = self.at[k, a], self.at[k, b - (1 << k)]
        return np.where(self.values[i] >= self.values[j], i, j)

    def reaches(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray, strictly: bool = False) -> np.ndarray:
        """Whether a value of a .. b-1 is at least the bound, or above it; an empty range has none."""
        out = np.zeros(len(a), bool)
        some = np.flatnonzero(b > a)
        best, bound = self.values[self.place(a[some], b[some])], bound[some]
        out[some] = best > bound if strictly else best >= bound
        return out

    def first(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray, strictly: bool = False) -> np.ndarray:
        """The first place in a .. b-1 whose value is at least the bound, or above it; b for none."""
        a = a.copy()
        for k in range(len(self.at) - 1, -1, -1):
            some = np.flatnonzero(a + (1 << k) <= b)
            best = self.values[self.at[k, a[some]]]
            missed = best <= bound[some] if strictly else best < bound[some]
            a[some[missed]] += 1 << k
        return a


def whole(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole instruments out of batches in their order: of so many rows and a batch at most, or of one longer instrument."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        last = batch["instrument"][-1]
        if n >= rows and last != held[0]["instrument"][0]:
            table = pa.Table.from_batches(held)
            cut = int(firsts(table)[-1])
            yield table.slice(0, cut)
            held = [b for b in table.slice(cut).to_batches() if b.num_rows]
            n -= cut
    if held:
        yield pa.Table.from_batches(held)


def by_instrument(bars: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str, rows: int = 40_000) -> DataFrame:
    """fn over tables of whole instruments, bars in order. Bars must be the output of windows by instrument and day, which leave them together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for table in whole(batches, rows):
                yield from fn(table.combine_chunks()).to_batches(max_chunksize=10_000)

    return bars.sortWithinPartitions("instrument", "trade_date").mapInArrow(run, schema)


def firsts(table: pa.Table) -> np.ndarray:
    """For each row the place of its instrument's first row; rows without instrument are of one."""
    ends = pc.run_end_encode(table["instrument"].combine_chunks()).run_ends.to_numpy()
    starts = np.concatenate([[0], ends[:-1]])
    return np.repeat(starts, ends - starts)


def picked(names: tuple[str | None, ...], codes: np.ndarray) -> pa.Array:
    """Texts by their number."""
    return pa.array(names, pa.string()).take(pa.array(codes))


def spread(values: np.ndarray, at: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """n rows with values at the given places and nulls elsewhere; NaN is null."""
    full, missing = np.zeros(n, values.dtype), np.ones(n, bool)
    full[at] = values
    missing[at] = np.isnan(values) if values.dtype.kind == "f" else False
    return pa.array(full, kind, mask=missing)


def lists(parts: pa.StructArray, counts: np.ndarray, at: np.ndarray, n: int) -> pa.ListArray:
    """n rows with lists of so many parts each at the given places and nulls elsewhere."""
    sizes, missing = np.zeros(n, np.int64), np.ones(n, bool)
    sizes[at] = counts
    missing[at] = False
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), parts, mask=pa.array(missing))
