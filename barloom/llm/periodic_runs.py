"""Periodic runs of words, found by internal pattern matching.

Texts are taken a batch at a time as one sequence of word numbers. Its suffix array comes from prefix doubling, whose ranks also name
every factor of a dyadic length, so a block's occurrences are an interval of the suffix array. A wavelet tree over that array
answers range-successor queries: the next occurrence of a block in the window behind it. A run of period q holds a dyadic
block of about q / 2 words and its copy q words on, so the distances to such occurrences are all the candidate periods there
are. Where occurrences stand in a progression, its step tells the block's own period, and a progression that lies in
one stretch with the block offers nothing but that step. Candidates are extended to both sides by the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.token_files import Numbers

#: Words of a batch of texts, but for a single longer text. A word takes some 300 bytes while its batch is at work.
BATCH_WORDS = 200_000
#: Candidates that are extended at a time.
AT_ONCE = 1_000_000
#: Distinct words that a worker numbers before it starts anew.
CACHE = 400_000
#: Size and step of the smallest blocks: each run of LEAST_LENGTH words or more with a period below 15 holds one and its copy.
BASE, STEP = 4, 2

RUNS = "doc_id long, n_words long, runs array<struct<start: int, length: int, period: int>>, collapsed string"


class Factors:
    """Suffix array of a sequence, and the ranks of its factors of length 1, 2, 4, ..: equal factors have equal ranks.

    A rank is the place of the first suffix that begins with the factor, so rank and size give the interval of its
    occurrences. Doubling goes on until all ranks differ or factors are longer than most. Each text ends in a number of its own.
    """

    def __init__(self, t: np.ndarray, most: int):
        n = len(t)
        self.n = n
        self.order = np.argsort(t, kind="stable")
        self.ranks, self.sizes = [], []
        self._name(t[self.order], self.order, np.arange(n), np.empty(n, np.int32), np.empty(n, np.int32))
        m = 1
        while m < most and (open_ := self.sizes[-1] > 1).any():
            rank = self.ranks[-1]
            slots = np.flatnonzero(open_[self.order])
            at = self.order[slots]
            nxt = np.where(at + m < n, rank[np.minimum(at + m, n - 1)], -1).astype(np.int64)
            key = rank[at].astype(np.int64) * (n + 1) + nxt + 1
            by = np.argsort(key, kind="stable")
            self.order[slots] = at[by]
            self._name(key[by], at[by], slots, rank.copy(), self.sizes[-1].copy())
            m *= 2
        self.top = len(self.ranks) - 1

    def _name(self, keys: np.ndarray, at: np.ndarray, slots: np.ndarray, rank: np.ndarray, size: np.ndarray) -> None:
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        group = np.diff(np.append(first, len(keys)))
        rank[at] = np.repeat(slots[first], group)
        size[at] = np.repeat(group, group)
        self.ranks.append(rank)
        self.sizes.append(size)

    def common_right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i and j on are the same, i < j."""
        got = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for k in (*[self.top] * 64, *range(self.top - 1, -1, -1)):
            if k == self.top:
                if not len(live):
                    continue
                a = got[live]
                live = live[self.ranks[k][i[live] + a] == self.ranks[k][j[live] + a]]
                got[live] += 1 << k
            else:
                got += (self.ranks[k][i + got] == self.ranks[k][j + got]).astype(np.int64) << k
        return got if not len(live) else got + self._rest(i + got, j + got, 1)

    def common_left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers that end before i and j are the same, i < j."""
        got = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for k in (*[self.top] * 64, *range(self.top - 1, -1, -1)):
            of = live if k == self.top else slice(None)
            a, b = i[of] - got[of] - (1 << k), j[of] - got[of] - (1 << k)
            same = (a >= 0) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])
            if k == self.top:
                live = live[same]
                got[live] += 1 << k
            else:
                got += same.astype(np.int64) << k
        return got if not len(live) else got + self._rest(i - got, j - got, -1)

    def _rest(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """What is common beyond 64 factors of the longest kind."""
        return self.common_right(i, j) if way > 0 else self.common_left(i, j)


class WaveletTree:
    """A wavelet tree in matrix form over a permutation of 0 .. n - 1."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(1, int(n).bit_length())
        self.zeros, self.split = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least value not below least among those at low .. high - 1; -1 where there is none."""
        below = np.zeros(len(low), np.int64)
        a, b = low, high
        for level, zeros in enumerate(self.zeros):
            za, zb = zeros[a], zeros[b]
            one = (least >> (self.bits - 1 - level) & 1).astype(bool)
            below += np.where(one, zb - za, 0)
            a, b = np.where(one, self.split[level] + a - za, za), np.where(one, self.split[level] + b - zb, zb)
        some = np.flatnonzero(below < high - low)
        out = np.full(len(low), -1, np.int64)
        a, b, k, value = low[some], high[some], below[some], np.zeros(len(some), np.int64)
        for level, zeros in enumerate(self.zeros):
            za, zb = zeros[a], zeros[b]
            one = k >= zb - za
            k = k - np.where(one, zb - za, 0)
            value = value * 2 + one
            a, b = np.where(one, self.split[level] + a - za, za), np.where(one, self.split[level] + b - zb, zb)
        out[some] = value
        return out


def candidates(f: Factors, tree: WaveletTree, begin: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q): places of blocks and distances at which a run of smallest period q may hold them and their copies.

    Blocks of m words give the periods 2m - 1 to 4m - 2, the smallest ones all below 15.
    """
    m = BASE
    while m <= 1 << f.top:
        step, least, most = (STEP, 1, 4 * m - 2) if m == BASE else (m, 2 * m - 1, 4 * m - 2)
        n_blocks = np.where(length >= m + least, (length - m - least) // step + 1, 0)
        if not n_blocks.any():
            return
        at = np.repeat(begin, n_blocks) + step * (np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
        k = m.bit_length() - 1
        at = at[f.sizes[k][at] > 1]
        low = f.ranks[k][at].astype(np.int64)
        high = low + f.sizes[k][at]
        found = tree.successor(low, high, at + least)
        while True:
            keep = (found >= 0) & (found <= at + most)
            at, low, high, found = at[keep], low[keep], high[keep], found[keep]
            if not len(at):
                break
            after = tree.successor(low, high, found + 1)
            step_of = after - found
            line = (after >= 0) & (step_of <= m // 2)
            yield at[~line], (found - at)[~line]
            if line.any():
                i, s, d = at[line], found[line], step_of[line]
                end = s + d + f.common_right(s, s + d)
                last = s + (end - m - s) // d * d
                # In one stretch with the block: all other distances are multiples of the step.
                one = ((s - i) % d == 0) & (i + d + f.common_right(i, i + d) >= s + m)
                yield i[one], d[one]
                i, s, d = i[~one], s[~one], d[~one]
                times = (np.minimum(last[~one], i + most) - s) // d + 1
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield np.repeat(i, times), np.repeat(s - i, times) + nth * np.repeat(d, times)
                after[line] = tree.successor(low[line], high[line], last + 1)
            found = after
        m *= 2


def runs_of(t: np.ndarray, begin: np.ndarray, length: np.ndarray, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts in t, by start and period."""
    f = Factors(t, int(length.max(initial=0)) // 2)
    tree = WaveletTree(f.order)
    out = [np.zeros((3, 0), np.int64)]
    for i, q in candidates(f, tree, begin, length):
        for k in range(0, len(i), AT_ONCE):
            a, p = i[k : k + AT_ONCE].astype(np.int64), q[k : k + AT_ONCE].astype(np.int64)
            right = f.common_right(a, a + p)
            left = f.common_left(a, a + p)
            good = left + right + p >= np.maximum(least_length, 2 * p)
            out.append(np.unique(np.stack([a - left, a + right + p, p])[:, good], axis=1))
    start, end, period = np.concatenate(out, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # Of equal stretches the smallest period is the run; what is longer is a multiple of it.
    first = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0)) if len(start) else np.zeros(0, bool)
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def batch_runs(ids: list, texts: list[list[bytes]], known: Numbers, least_length: int) -> pa.RecordBatch:
    """The rows of RUNS for a batch of texts as words."""
    length = np.array([len(w) for w in texts], np.int64)
    begin = np.cumsum(length + 1) - length - 1
    t = np.empty(int((length + 1).sum()), np.int64)
    for k, (b, w) in enumerate(zip(begin.tolist(), texts, strict=True)):
        t[b : b + len(w)] = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
        t[b + len(w)] = -1 - k
    start, size, period = runs_of(t, begin, length, least_length)
    doc = np.searchsorted(begin, start, "right") - 1
    change = np.zeros(len(t) + 1, np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + size, -1)
    kept = np.cumsum(change[:-1]) == 0
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    joined = [b" ".join(w if a == z else compress(w, kept[b : b + len(w)].tolist())) for b, w, a, z in zip(begin.tolist(), texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]
    parts = [pa.array(x.astype(np.int32)) for x in (start - begin[doc], size, period)]
    runs = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
    columns = [pa.array(ids, pa.int64()), pa.array(length), runs, pa.array(joined, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least_length: int = 12, batch_words: int = BATCH_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are what stands between blanks [\\x20\\x09-\\x0D], numbered from 0. A run is a stretch of words with smallest period q, at
    least max(least_length, 2 q) long, that no neighbour extends. collapsed has the words that no run covers after its
    first q words, joined by one space. Null and empty texts have no words and no runs; repeated rows and rows without doc_id come
    back each; other columns are neither read nor returned. A text of any length is one piece of work: some 300 bytes a word.
    least_length is 12 or more, as shorter runs could hold no whole block.
    """
    if least_length < 12:
        raise ValueError("least_length must be 12 or more")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, texts, total = Numbers(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if ids and total + len(w) > batch_words:
                    yield batch_runs(ids, texts, known, least_length)
                    ids, texts, total = [], [], 0
                    if len(known) > CACHE:
                        known = Numbers()
                ids.append(doc_id)
                texts.append(w)
                total += len(w)
        if ids:
            yield batch_runs(ids, texts, known, least_length)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(find, RUNS)


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by a hash of doc_id, made to repeat p of their words from word a on; the others as they are.

    A text without words, and one without doc_id, stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    words = F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.filter(F.split("text", "[ \t\n\x0b\f\r]+"), lambda w: w != ""))
    rows = rows.withColumn("w", words).withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.lit(1).cast("long") + F.expr("(n - a) div (3 + g % 8)"))
    again = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.when(F.col("a").isNotNull(), F.array_join(F.transform("w", again), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def op11(docs: DataFrame) -> DataFrame:
    found = periodic_runs(repeating(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(line, "").alias("listed"), "collapsed")
    start, length, period = ((sign * F.col(f"best.{c}")).cast("long") for c, sign in (("back", -1), ("length", 1), ("less", -1)))
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("cast(1000 * best.length as long) div cast(-best.less as long)").alias("exponent_milli"),
        digest(F.col("listed")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
