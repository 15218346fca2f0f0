"""Suffix order of a text beyond memory, by external induced sorting.

Suffixes are split in those greater than their successor and those smaller. The leftmost of the smaller ones are sorted by
their substrings, named, and the names sorted by recursion; from their order all others follow in two sweeps: a
suffix taken from the queue puts its predecessor in. The queue is a priority queue on disk: tuples of symbol, place and
common prefix, in buckets by symbol that are first in, first out, as tuples of one symbol come in order. Common prefixes
are carried along: that of two predecessors is one more than the least met between their suffixes.

What is held in memory: up to `budget` tuples, a table over a chunk, and two bytes a distinct symbol. The text, the queues, the
names and the results are files in a scratch folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from barloom.llm.periodic_runs import Factors

#: Tuples that a step of a sweep takes.
CHUNK = 65_536
#: Common prefixes are counted up to here.
MOST = 65_535
#: Alphabets up to this size get one bucket a symbol.
NARROW = 1_024


def tuples(n: int) -> np.dtype:
    """A queue's tuple for a text of n symbols."""
    return np.dtype([("symbol", "<u4"), ("place", place_type(n)), ("lcp", "<u2")])


def place_type(n: int) -> str:
    return "<u4" if n < 1 << 32 else "<i8"


class Column:
    """A growing array in a file."""

    def __init__(self, path: str, kind: type):
        self.path, self.kind, self.n = path, np.dtype(kind), 0
        self.file = open(path, "wb")  # noqa: SIM115

    def add(self, values: np.ndarray) -> None:
        values.astype(self.kind, copy=False).tofile(self.file)
        self.n += len(values)

    def read(self) -> np.ndarray:
        self.file.close()
        return np.memmap(self.path, self.kind, "r") if self.n else np.zeros(0, self.kind)


class Queue:
    """A priority queue on disk: tuples in buckets, first in, first out; all go to a file when there are more than budget."""

    def __init__(self, path: str, n_buckets: int, budget: int, kind: np.dtype):
        self.kind = kind
        self.file = open(path, "w+b")  # noqa: SIM115
        self.budget, self.held = budget, 0
        self.memory: list[list[np.ndarray]] = [[] for _ in range(n_buckets)]
        self.disk: list[list[tuple[int, int]]] = [[] for _ in range(n_buckets)]

    def put(self, bucket: np.ndarray, tuples: np.ndarray) -> None:
        """Tuples of ascending buckets."""
        cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for b, part in zip(bucket[np.append(0, cut)].tolist(), np.split(tuples, cut), strict=True):
            self.memory[b].append(part)
        self.held += len(tuples)
        if self.held > self.budget:
            self.file.seek(0, os.SEEK_END)
            for b, parts in enumerate(self.memory):
                if parts:
                    rows = np.concatenate(parts)
                    self.disk[b].append((self.file.tell(), len(rows)))
                    self.file.write(rows.tobytes())
                    self.memory[b] = []
            self.held = 0

    def take(self, bucket: int) -> Iterator[np.ndarray]:
        """The tuples of a bucket in the order in which they came, a chunk at a time."""
        parts, places = self.memory[bucket], self.disk[bucket]
        self.memory[bucket], self.disk[bucket] = [], []
        self.held -= sum(map(len, parts))
        for at, n in places:
            for k in range(0, n, CHUNK):
                self.file.seek(at + k * self.kind.itemsize)
                yield np.frombuffer(self.file.read(min(CHUNK, n - k) * self.kind.itemsize), self.kind)
        if parts:
            rows = np.concatenate(parts)
            for k in range(0, len(rows), CHUNK):
                yield rows[k : k + CHUNK]

    def close(self) -> None:
        self.file.close()
        os.unlink(self.file.name)


class Least:
    """Range minima over a short array."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (step := 1 << (len(self.rows) - 1)) * 2 <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
        self.flat = np.concatenate(self.rows)
        self.at = np.cumsum([0, *map(len, self.rows)])[:-1]

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of low .. high, both included."""
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.flat[self.at[k] + low], self.flat[self.at[k] + high - (1 << k) + 1])


def run_lengths(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often the symbol at each place comes in a row from there on."""
    out = np.ones(len(place), np.int64)
    live = np.arange(len(place))
    while len(live):
        at = place[live] + out[live]
        live = live[(at < len(text)) & (text[np.minimum(at, len(text) - 1)] == text[place[live]])]
        live = live[out[live] < MOST]
        out[live] += 1
    return out


def buckets_of(counts: np.ndarray, budget: int) -> np.ndarray:
    """The first symbol of each bucket: neighbours share one up to some suffixes, frequent symbols have their own."""
    if len(counts) <= NARROW:
        return np.arange(len(counts) + 1)
    before, most = np.cumsum(counts) - counts, max(2, min(budget, CHUNK) // 4)
    own = counts > most // 4
    new = np.append(True, np.diff(before // most) > 0) | own | np.append(False, own[:-1])
    return np.append(np.flatnonzero(new), len(counts))


class Sweep:
    """One sweep of induction over a text, upwards or (flipped) downwards; see step() and sweep()."""

    def __init__(self, text: np.ndarray, counts: np.ndarray, flip: bool, scratch: str, budget: int):
        self.text, self.flip, self.k = text, flip, len(counts)
        self.first = buckets_of(counts[::-1] if flip else counts, budget)
        self.bucket = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.kind = tuples(len(text))
        self.queue = Queue(os.path.join(scratch, f"queue-{flip}"), len(self.first) - 1, budget, self.kind)
        #: The least common prefix met since a symbol last came in.
        self.since = np.full(self.k, MOST, np.uint16)

    def symbols(self, place: np.ndarray) -> np.ndarray:
        s = self.text[place].astype(np.int64)
        return self.k - 1 - s if self.flip else s

    def step(self, symbol: np.ndarray, place: np.ndarray, lcp: np.ndarray, seed: np.ndarray, upto: int, inside: bool) -> np.ndarray | None:
        """Puts in the predecessors of suffixes that come in this order; those of symbols below upto are returned if inside."""
        before = self.symbols(np.maximum(place - 1, 0))
        comes = np.flatnonzero((place > 0) & (before >= symbol + seed))
        lowest = lcp.min()
        if not len(comes):
            np.minimum(self.since, lowest, out=self.since)
            return None
        keys = before[comes]
        by = np.argsort(keys.astype(np.uint16) if self.k <= MOST else keys, kind="stable")
        i, keys = comes[by], keys[by]
        new = np.append(True, keys[1:] != keys[:-1])
        got = np.empty(len(i), np.int64)
        got[~new] = Least(lcp).of(i[:-1][~new[1:]] + 1, i[1:][~new[1:]])
        got[new] = np.minimum(self.since[keys[new]], np.minimum.accumulate(lcp)[i[new]])
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint16(MOST))
        last = np.append(new[1:], True)
        np.minimum(self.since, lowest, out=self.since)
        self.since[keys[last]] = after[i[last] + 1]
        rows = np.empty(len(i), self.kind)
        rows["symbol"], rows["place"], rows["lcp"] = keys, place[i] - 1, np.minimum(got + 1, MOST)
        n_here = int(np.searchsorted(keys, upto))
        if n_here < len(rows):
            self.queue.put(self.bucket[keys[n_here:]], rows[n_here:])
        return rows[:n_here] if inside and n_here else None

    def sweep(self, seeds, truncated: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(symbol, place, lcp with the one before, seed) of all suffixes met, in order. seeds(low, high) gives seeds by symbol.

        truncated: seeds stand for their first symbol alone.
        """
        for b in range(len(self.first) - 1):
            low, high = int(self.first[b]), int(self.first[b + 1])
            for part in self._one(b, low, seeds, truncated) if high - low == 1 else self._many(b, low, high, seeds, truncated):
                yield part
        self.queue.close()

    def _one(self, b: int, symbol: int, seeds, truncated: bool) -> Iterator:
        """A bucket of one symbol: rounds of suffixes that begin with it once, twice, .. , and then the seeds."""
        last, rounds = None, self.queue.take(b)
        while rounds is not None:
            more = []
            for rows in rounds:
                lcp = rows["lcp"].copy()
                if last is None:
                    lcp[0] = 0
                last = int(rows["place"][-1])
                sym, no = np.full(len(rows), symbol), np.zeros(len(rows), bool)
                place = rows["place"].astype(np.int64)
                again = self.step(sym, place, lcp, no, symbol + 1, True)
                if again is not None:
                    more.append(again)
                yield sym, place, lcp, no
            rounds = iter(more) if more else None
        begun = False
        for place, lcp in seeds(symbol, symbol + 1):
            lcp = lcp.copy()
            if not begun:
                both = np.array([last if last is not None else 0, place[0]])
                lcp[0] = 0 if last is None else 1 if truncated else run_lengths(self.text, both).min()
                begun = True
            sym, yes = np.full(len(place), symbol), np.ones(len(place), bool)
            self.step(sym, place, lcp, yes, symbol + 1, False)
            yield sym, place, lcp, yes

    def _many(self, b: int, low: int, high: int, seeds, truncated: bool) -> Iterator:
        """A bucket of several symbols: what comes in from within it is found first, then all is put in order together."""
        rows = np.concatenate([*self.queue.take(b), np.zeros(0, self.kind)])
        got = [(p, e) for p, e in seeds(low, high)]
        seed_place = np.concatenate([np.zeros(0, np.int64), *[p for p, _ in got]])
        seed_lcp = np.concatenate([np.zeros(0, np.uint16), *[e for _, e in got]])
        n_out, n_seed = len(rows), len(seed_place)
        symbol = np.concatenate([rows["symbol"].astype(np.int64), self.symbols(seed_place)])
        place = np.concatenate([rows["place"].astype(np.int64), seed_place])
        seed = np.arange(n_out + n_seed) >= n_out
        if not len(place):
            return
        parent, front = np.full(len(place), -1), np.arange(len(place))
        while len(front):
            before = self.symbols(np.maximum(place[front] - 1, 0))
            comes = (place[front] > 0) & (before >= symbol[front] + seed[front]) & (before < high)
            front, n = front[comes], len(place)
            symbol, place = np.append(symbol, before[comes]), np.append(place, place[front] - 1)
            parent, seed = np.append(parent, front), np.append(seed, np.zeros(len(front), bool))
            front = np.arange(n, len(place))
        within = np.flatnonzero(parent >= 0)
        turn = np.arange(len(place))
        order = np.lexsort((turn, seed, symbol))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        while len(within):
            turn[within] = len(place) + rank[parent[within]]
            order = np.lexsort((turn, seed, symbol))
            new = np.empty(len(order), np.int64)
            new[order] = np.arange(len(order))
            if (new == rank).all():
                break
            rank = new
        lcp = np.concatenate([rows["lcp"], seed_lcp, np.full(len(within), MOST, np.uint16)])[order]
        symbol, place, seed, up = symbol[order], place[order], seed[order], parent[order]
        same = np.append(False, symbol[1:] == symbol[:-1])
        lcp[~same] = 0
        seam = np.flatnonzero(same & seed & ~np.append(False, seed[:-1]))
        lcp[seam] = 1 if truncated else np.minimum(np.minimum(run_lengths(self.text, place[seam]), run_lengths(self.text, place[seam - 1])), MOST)
        mine = np.flatnonzero(same & (up >= 0))
        apart = up[mine - 1] < 0
        lcp[mine[apart]] = 1
        mine = mine[~apart]
        low_at, high_at = rank[up[mine - 1]] + 1, rank[up[mine]]
        while len(mine):
            now = np.minimum(Least(lcp).of(low_at, high_at).astype(np.int64) + 1, MOST)
            if (now == lcp[mine]).all():
                break
            lcp[mine] = now
        for k in range(0, len(place), CHUNK):
            s = slice(k, k + CHUNK)
            self.step(symbol[s], place[s], lcp[s], seed[s], high, False)
            yield symbol[s], place[s], lcp[s], seed[s]


def leftmost_smaller(text: np.ndarray) -> Iterator[np.ndarray]:
    """Places, from the end on, of suffixes smaller than their successor whose predecessor is greater; the last place is one."""
    n, smaller_next = len(text), True
    for b in range(n, 0, -CHUNK):
        a = max(0, b - CHUNK)
        x = text[a : min(b + 1, n)].astype(np.int64)
        if b == n:
            x = np.append(x, x[-1] + 1)
        d = np.sign(np.diff(x))
        at = np.where(d != 0, np.arange(len(d)), len(d))
        at = np.minimum.accumulate(at[::-1])[::-1]
        smaller = np.append(d > 0, smaller_next)[at]
        before = np.append(text[a - 1] if a else 0, x[:-2]).astype(np.int64)
        yield a + np.flatnonzero(smaller & (before > x[:-1]))
        smaller_next = bool(smaller[0])


def in_memory(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, lcp) from the greatest suffix down, by prefix doubling: for texts that fit. The last symbol comes once."""
    f = Factors(np.asarray(text, np.int64), len(text))
    lcp = f.common_right(f.order[:-1], f.order[1:])
    return f.order[::-1], np.append(0, np.minimum(lcp, MOST)[::-1]).astype(np.uint16)


def chunks_of(place: np.ndarray, lcp: np.ndarray, low: int, high: int, reverse: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Seeds low .. high - 1 of columns in chunks; reversed, the common prefix of a seed is that with the one behind it."""
    for k in range(0, high - low, CHUNK):
        n = min(CHUNK, high - low - k)
        if reverse:
            b = high - k
            e = lcp[b - n + 1 : b + 1][::-1] if b < len(lcp) else np.append(np.uint16(0), lcp[b - n + 1 : b][::-1])
            yield place[b - n : b][::-1].astype(np.int64), np.asarray(e)
        else:
            yield place[low + k : low + k + n].astype(np.int64), np.asarray(lcp[low + k : low + k + n])


def suffix_files(text: np.ndarray, n_symbols: int, scratch: str, budget: int, fits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lcp) of suffix_order(), as files."""
    os.makedirs(scratch, exist_ok=True)
    out, shared = Column(os.path.join(scratch, "suffixes"), place_type(len(text))), Column(os.path.join(scratch, "suffixes-lcp"), np.uint16)
    for place, lcp in suffix_order(text, n_symbols, scratch, budget, fits):
        out.add(place)
        shared.add(lcp)
    return out.read(), shared.read()


def suffix_order(text: np.ndarray, n_symbols: int, scratch: str, budget: int, fits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lcp) of all suffixes from the greatest down, a part at a time; lcp is that with the suffix before.

    text holds symbols below n_symbols and ends in its only 0. Names of up to `fits` places are sorted in memory, longer
    ones by recursion. No symbol may come 65,000 times in a row.
    """
    os.makedirs(scratch, exist_ok=True)
    at = lambda name: os.path.join(scratch, name)
    n = len(text)
    kind = place_type(n)

    def drop(*names: str) -> None:
        for name in names:
            os.unlink(at(name))

    counts = np.zeros(n_symbols, np.int64)
    for k in range(0, n, CHUNK * 16):
        counts += np.bincount(text[k : k + CHUNK * 16], minlength=n_symbols)
    # The leftmost smaller suffixes, their symbols' counts, and the distance of each to the next.
    stars = Column(at("stars"), kind)
    length = np.memmap(at("length"), np.uint16, "w+", shape=n // 2 + 1)
    star_counts, following = np.zeros(n_symbols, np.int64), n - 1
    by_symbol = Queue(at("by-symbol"), len(first := buckets_of(counts, budget)) - 1, budget, tuples(n))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for place in leftmost_smaller(text):
        if not len(place):
            continue
        stars.add(place[::-1])
        span = np.diff(np.append(place, following)) + 1
        length[place >> 1] = np.minimum(span, MOST)
        following = place[0]
        symbol = text[place].astype(np.int64)
        star_counts += np.bincount(symbol, minlength=n_symbols)
        by = np.argsort(symbol, kind="stable")
        rows = np.zeros(len(place), tuples(n))
        rows["symbol"], rows["place"], rows["lcp"] = symbol[by], place[by], 1
        by_symbol.put(owner[symbol[by]], rows)
    backwards = stars.read()
    n_stars = len(backwards)

    def unsorted(low: int, high: int) -> Iterator:
        rows = np.concatenate([*by_symbol.take(int(owner[low])), np.zeros(0, tuples(n))])
        rows = rows[np.argsort(rows["symbol"], kind="stable")] if high - low > 1 else rows
        for k in range(0, len(rows), CHUNK):
            yield rows["place"][k : k + CHUNK].astype(np.int64), rows["lcp"][k : k + CHUNK]

    def greater(seeds, truncated: bool, name: str) -> tuple:
        """The sweep upwards; its greater suffixes, which are the seeds of the sweep downwards."""
        place_at, lcp_at, upto = Column(at(name), kind), Column(at(name + "-lcp"), np.uint16), np.zeros(n_symbols, np.int64)
        for symbol, place, lcp, seed in Sweep(text, counts, False, scratch, budget).sweep(seeds, truncated):
            if not seed.all():
                place_at.add(place[~seed])
                lcp_at.add(lcp[~seed])
                s = symbol[~seed]
                cut = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                upto[s[cut]] += np.diff(np.append(cut, len(s)))
        place, lcp, end = place_at.read(), lcp_at.read(), np.cumsum(upto)
        return lambda low, high: chunks_of(place, lcp, int((end - upto)[n_symbols - high]), int(end[n_symbols - low - 1]), True)

    # Sort and name their substrings, the greatest first.
    down = greater(unsorted, True, "rough")
    by_symbol.close()
    order, edges, n_names = Column(at("order"), kind), Column(at("edges"), np.uint16), 0
    names = np.memmap(at("names"), np.uint32, "w+", shape=n // 2 + 1)
    least, last_span = MOST, -1
    for symbol, place, lcp, seed in Sweep(text, counts, True, scratch, budget).sweep(down, False):
        before = text[np.maximum(place - 1, 0)].astype(np.int64)
        here = np.flatnonzero(~seed & (place > 0) & (before > n_symbols - 1 - symbol))
        if len(here):
            shared = np.minimum.reduceat(lcp[: here[-1] + 1], np.append(0, here[:-1] + 1)).astype(np.int64)
            shared[0] = min(int(shared[0]), least)
            span = length[place[here] >> 1].astype(np.int64)
            same = (shared == span) & (np.append(last_span, span[:-1]) == span) & (span < MOST)
            name = n_names + np.cumsum(~same)
            edges.add(np.minimum(shared, MOST)[~same])
            names[place[here] >> 1] = name
            order.add(place[here])
            n_names, last_span = int(name[-1]), int(span[-1])
        least = int(lcp[here[-1] + 1 :].min(initial=MOST)) if len(here) else min(least, int(lcp.min()))
    del down, length
    drop("rough", "rough-lcp", "length")
    # The last place is the least and a name of its own.
    n_names += 1
    edges.add(np.zeros(1, np.uint16))
    names[(n - 1) >> 1] = n_names
    order.add(np.array([n - 1]))
    named = np.memmap(at("named"), np.uint32, "w+", shape=n_stars)
    for k in range(0, n_stars, CHUNK):
        part = backwards[k : k + CHUNK]
        named[n_stars - k - len(part) : n_stars - k] = (n_names - names[part >> 1])[::-1]
    del names
    drop("names")
    # Sort the suffixes they begin, by their names' suffixes.
    spot = lambda i: backwards[n_stars - 1 - i].astype(np.int64)
    if n_names == n_stars:
        places, shared = order.read(), np.zeros(n_stars, np.uint16)
        index = None
    else:
        order.read()
        index, shared = in_memory(named) if n_stars <= fits else suffix_files(named, n_names, at("names-sorted"), budget, fits)
    edge = edges.read()
    table = Least(np.asarray(edge))
    seed_place, seed_lcp = Column(at("seeds"), kind), Column(at("seeds-lcp"), np.uint16)
    for k in range(0, n_stars, CHUNK):
        if index is None:
            b = places[k : k + CHUNK].astype(np.int64)
            a = np.append(places[k - 1] if k else b[0], b[:-1])
            # All names differ, so they stand in their own order.
            lcp = np.asarray(edge[k : k + CHUNK]).astype(np.int64)
        else:
            j = index[k : k + CHUNK].astype(np.int64)
            i = np.append(index[k - 1] if k else j[0], j[:-1])
            h = np.asarray(shared[k : k + CHUNK]).astype(np.int64)
            if k == 0:
                h[0] = 0
            a, b = spot(i), spot(j)
            x, y = (n_names - 1 - named[np.minimum(z + h, n_stars - 1)].astype(np.int64) for z in (i, j))
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            lcp = spot(np.minimum(j + h, n_stars - 1)) - b + np.where(lo < hi, table.of(np.minimum(lo + 1, hi), hi), 0)
        live = np.flatnonzero(a != b)
        while len(live):
            u, v = a[live] + lcp[live], b[live] + lcp[live]
            live = live[(np.maximum(u, v) < n) & (text[np.minimum(u, n - 1)] == text[np.minimum(v, n - 1)]) & (lcp[live] < MOST)]
            lcp[live] += 1
        seed_place.add(b)
        seed_lcp.add(np.minimum(lcp, MOST))
    index = shared = places = named = backwards = None
    drop("named", "order", "edges", "stars")
    place, lcp, end = seed_place.read(), seed_lcp.read(), np.cumsum(star_counts)
    starts = end - star_counts

    def ordered(low: int, high: int) -> Iterator:
        return chunks_of(place, lcp, int(n_stars - end[high - 1]), int(n_stars - starts[low]), True)

    down = greater(ordered, False, "greater")
    place = lcp = None
    drop("seeds", "seeds-lcp")
    for _, place_, lcp_, _ in Sweep(text, counts, True, scratch, budget).sweep(down, False):
        yield place_, lcp_
    yield np.array([n - 1]), np.zeros(1, np.uint16)
    del down
    drop("greater", "greater-lcp")
