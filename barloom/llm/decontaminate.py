"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed once, in segments of one row each: for every term that the benchmark may use, the positions at which the
segment holds it. A search takes each benchmark window, starts from the postings of its rarest term over the whole
corpus, and intersects the other terms' lists, shifted by their offsets, from rare to frequent. Nothing
is shuffled but term counts: postings and search stay with their segment, so a frequent passage hurts no one task.
The benchmark's windows are taken in blocks of bounded size, each against the one index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from barloom.llm.shared import stored

#: Byte by byte: A-Z lower-cased, 0-9 a-z and all of non-ASCII kept, the rest blank.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms of the benchmark that one block may hold, at 8 bytes each. A block's windows take some 25 times that in the driver, a broadcast and a worker.
BLOCK_BYTES = 2_000_000
#: Words of an item that one piece of it may hold.
PIECE_WORDS = 2_000
#: Bits of the filter of benchmark terms: 1 MB, however many terms there are. Terms beside the benchmark's that pass it are indexed for nothing.
FILTER_BITS = 2**23
#: Bits that one row of the filter holds.
FILTER_ROW = 32_768
#: Words that one segment of the index may hold, but for a single longer document.
SEGMENT_WORDS = 1_000_000
#: Candidate positions that are intersected at a time.
AT_ONCE = 2_000_000
#: Distinct words whose hashes a worker keeps.
CACHE = 400_000

SEGMENT = "doc_id array<long>, text_key array<long>, n_words array<int>, term array<long>, n array<int>, postings binary"
HITS = "doc_id long, text_key long, n_words long, starts array<int>, ends array<int>, items array<string>, near array<string>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


def term_of(word: bytes) -> int:
    """64 bits that stand for a word; 0 and below stand for none."""
    return (xxhash.xxh3_64_intdigest(word) >> 1) or 1


class Terms(dict):
    """Terms of words as they are met: 0 for a word that the filter of benchmark terms rules out."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: bytes) -> int:
        term = term_of(word)
        self[word] = term = term if self.bits[term % FILTER_BITS] else 0
        return term


class Windows:
    """The windows of a block of pieces: terms, 0 behind a short window's end, and which items have each."""

    def __init__(self, names: list[str | None], pieces: list[list[int]], size: int, slop: int = 0):
        self.size, self.slop, self.gap = size, slop, size + slop
        self.names = pa.array(names, pa.string())
        n = np.array([max(1, len(ids) - size + 1) if ids else 0 for ids in pieces], np.int64)
        every, first = np.zeros((int(n.sum()), size), np.int64), np.cumsum(n) - n
        for at, many, ids in zip(first.tolist(), n.tolist(), pieces, strict=True):
            short = np.array(ids[:size], np.int64)
            every[at : at + many, : len(short)] = np.lib.stride_tricks.sliding_window_view(np.array(ids, np.int64), size) if len(ids) >= size else short
        order = np.lexsort(every.T)
        every, owner = every[order], np.repeat(np.arange(len(pieces), dtype=np.int32), n)[order]
        # Sorting is stable, so a window's items come in order; an item that has it twice has it once.
        new = np.append(True, (every[1:] != every[:-1]).any(1)) if len(every) else np.zeros(0, bool)
        once = new | np.append(True, owner[1:] != owner[:-1]) if len(every) else new
        self.ids, self.items = every[new], owner[once]
        self.lengths = (self.ids > 0).sum(1).astype(np.int32)
        self.item_at = np.append(np.flatnonzero(new[once]), len(self.items)).astype(np.int64)

    def terms(self) -> np.ndarray:
        return np.setdiff1d(self.ids, [0])

    def ordered(self, terms: np.ndarray, df: np.ndarray) -> None:
        """Rarest terms first, by df of the ascending terms; a window with a term that the corpus lacks goes."""
        at = np.searchsorted(terms, self.ids)
        often = np.where(self.ids > 0, df[np.minimum(at, len(df) - 1)] if len(df) else 0, np.iinfo(np.int64).max)
        keep = np.flatnonzero((often > 0).all(1))
        counts = np.diff(self.item_at)[keep]
        self.items = np.concatenate([self.items[self.item_at[k] : self.item_at[k + 1]] for k in keep] or [self.items[:0]])
        self.item_at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.lengths = self.lengths[keep]
        self.offsets = np.argsort(often[keep], axis=1, kind="stable").astype(np.int32)
        self.ranked = np.take_along_axis(self.ids[keep], self.offsets, 1)


def item_pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, terms): distinct pieces of the items' terms; pieces of one item share size - 1 words, so each window is in just one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, pieces = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = [term_of(w) for w in words(text.as_buffer().to_pybytes() if text.is_valid else None)]
                for k in range(0, max(1, len(ids) - size + 1) if ids else 0, PIECE_WORDS):
                    names.append(name)
                    pieces.append(ids[k : k + PIECE_WORDS + size - 1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.list_(pa.int64()))], names=["item_id", "terms"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return stored(items.mapInArrow(cut, "item_id string, terms array<long>").distinct(), "benchmark-pieces")


def item_blocks(pieces: DataFrame, block_bytes: int) -> Iterator[list[Row]]:
    """The pieces, a block of about block_bytes at a time, at 8 bytes a word. All come; a piece is small, so blocks are even."""
    size = 8 * (pieces.agg(F.sum(F.size("terms"))).first()[0] or 0)
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        yield pieces.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n)) == k).collect()


def term_filter(pieces: DataFrame) -> np.ndarray:
    """FILTER_BITS booleans, true at each benchmark term's place."""
    place = pieces.select(F.explode("terms").alias("t")).select((F.col("t") % FILTER_BITS).alias("t"))
    rows = place.groupBy((F.col("t") / FILTER_ROW).cast("int").alias("row")).agg(F.bitmap_construct_agg((F.col("t") % FILTER_ROW).cast("long")).alias("bits"))
    out = np.zeros(FILTER_BITS, bool)
    for r in rows.collect():
        out[r.row * FILTER_ROW : (r.row + 1) * FILTER_ROW] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    return out


def index_segments(docs: DataFrame, bits: np.ndarray, gap: int) -> DataFrame:
    """Segments of the positional index over docs(doc_id, text) for terms that pass the filter, one row each; see SEGMENT.

    Positions count the words of a segment, with gap empty places behind each document. Postings are steps, term by term.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    schema = pa.schema([("doc_id", pa.list_(pa.int64())), ("text_key", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("term", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("postings", pa.binary())])

    def segment(ids: list, keys: list, lengths: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        row = np.concatenate(found)
        at = np.flatnonzero(row)
        at = at[np.argsort(row[at], kind="stable")].astype(np.int32)
        term, n = np.unique(row[at], return_counts=True)
        steps = np.diff(at, prepend=np.int32(0)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((ids, keys, lengths, term, n.astype(np.int32), steps.tobytes()), schema, strict=True)], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(np.unpackbits(shared.value).astype(bool))
        ids, keys, lengths, found, total, blank = [], [], [], [], 0, np.zeros(gap, np.int64)
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                w = words(text.as_buffer().to_pybytes() if text.is_valid else None)
                if ids and total + len(w) > SEGMENT_WORDS:
                    yield segment(ids, keys, lengths, found)
                    ids, keys, lengths, found, total = [], [], [], [], 0
                if len(known) > CACHE:
                    known.clear()
                ids.append(doc_id)
                keys.append(key)
                lengths.append(len(w))
                total += len(w) + gap
                found += [np.fromiter(map(known.__getitem__, w), np.int64, len(w)), blank]
        if ids:
            yield segment(ids, keys, lengths, found)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(build, SEGMENT), "positional-index")


class Postings:
    """A segment's posting lists, behind each other in one ascending array: a term's number times span plus position."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, length: int):
        self.terms, self.span = terms, length + 1
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts
        self.positions = positions
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64) * self.span, counts) + positions

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The terms' numbers in the segment, -1 for a term that it lacks."""
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def next_from(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first posting at or behind each position in each term's list; the span's end where the list has none."""
        at = np.searchsorted(self.keys, number * self.span + np.clip(position, 0, self.span - 1))
        there = at < self.ends[number]
        return np.where(there, self.positions[np.minimum(at, len(self.positions) - 1)], self.span)


def intersect(lists: Postings, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, window, exact) of each match in a segment: lists intersected from the rarest term on, shifted by the terms' offsets.

    With slop, a window also matches where each term stands within slop words of its place beside the rarest term.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    number = np.where(w.ranked > 0, lists.numbers(w.ranked), 0) if len(w.ranked) else w.ranked
    live = np.flatnonzero((number >= 0).all(1)) if len(w.ranked) else np.zeros(0, np.int64)
    begins, sizes = lists.begins[number[live, 0]], (lists.ends - lists.begins)[number[live, 0]]
    upto, slop = np.cumsum(sizes), w.slop
    while len(live):
        k = max(1, int(np.searchsorted(upto, AT_ONCE, "right")))
        part, size, begin = live[:k], sizes[:k], begins[:k]
        live, sizes, begins, upto = live[k:], sizes[k:], begins[k:], upto[k:] - upto[k - 1]
        win = np.repeat(part, size)
        which = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(win))
        start = lists.positions[which] - w.offsets[win, 0]
        exact = np.ones(len(win), bool)
        for r in range(1, w.size):
            long = w.ranked[win, r] > 0
            at, of = start + w.offsets[win, r], number[win, r]
            got = lists.next_from(of, at - slop)
            here = ~long | (got == at)
            if slop:
                exact &= here | (lists.next_from(of, at) == at)
                here = ~long | (got <= at + slop)
            win, start, exact = win[here], start[here], exact[here]
        out.append((start, win, exact))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def search(segments: DataFrame, windows: Windows) -> DataFrame:
    """HITS of each document of the index: merged runs of hit words, items with an exact window, items with a near one."""
    plan = segments.sparkSession.sparkContext.broadcast(windows)
    kinds = [pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "text_key", "n_words", "starts", "ends", "items", "near"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = plan.value
        for batch in batches:
            for s in batch.to_pylist():
                lengths = np.array(s["n_words"], np.int64)
                first = np.concatenate([[0], np.cumsum(lengths + w.gap)])
                n = np.array(s["n"], np.int64)
                positions = np.cumsum(np.frombuffer(s["postings"], np.int32).astype(np.int64))
                start, win, exact = intersect(Postings(np.array(s["term"], np.int64), n, positions, int(first[-1])), w)
                doc = np.searchsorted(first, start + w.offsets[win, 0], "right") - 1
                change = np.zeros(int(first[-1]) + 1, np.int32)
                np.add.at(change, start[exact], 1)
                np.add.at(change, start[exact] + w.lengths[win[exact]], -1)
                hit = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=np.int8(0))
                run_start, run_end = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
                run_doc = np.searchsorted(first, run_start, "right") - 1
                named = []
                for of in (exact, ~exact):
                    d, x = doc[of], win[of]
                    many = w.item_at[x + 1] - w.item_at[x]
                    where = np.repeat(w.item_at[x] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    pairs = np.unique(np.stack([np.repeat(d, many), w.items[where]]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
                    named.append(by_doc(pairs[0], w.names.take(pa.array(pairs[1])), len(lengths)))
                runs = [by_doc(run_doc, pa.array((x - first[run_doc]).astype(np.int32)), len(lengths)) for x in (run_start, run_end)]
                plain = [pa.array(x, t) for x, t in zip((s["doc_id"], s["text_key"], lengths), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*plain, *runs, *named], names=names)

    return segments.mapInArrow(find, HITS)


def by_doc(doc: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """Values grouped in n lists; doc is ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, text_key (a hash of the text), n_words, n_hit, item_ids (strings, sorted), near_ids, contaminated.

    Words are runs of 0-9, a-z and non-ASCII after lower-casing A-Z. A window is size consecutive words of an item, or a
    shorter item's whole; words inside any occurrence of a window are hit. near_ids are items of which some window
    occurs with its words up to slop places off, and not exactly. A null text has no words; an item without words has
    no window. An item without id hits words but is not listed; repeated items count once, repeated documents each.
    Other columns are neither read nor returned. An empty benchmark hits nothing. The rarest word of a window is the one that
    documents hold least often, the first of equals; the others' places are measured from it.
    """
    pieces = item_pieces(benchmark, size)
    segments = index_segments(docs, term_filter(pieces), size + slop)
    counts = stored(segments.select(F.explode(F.arrays_zip("term", "n")).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n")), "term-counts")
    parts = []
    for block in item_blocks(pieces, block_bytes):
        windows = Windows([r.item_id for r in block], [r.terms for r in block], size, slop)
        terms = windows.terms()
        own = docs.sparkSession.createDataFrame(pa.table({"term": terms}))
        got = {r.term: r.n for r in counts.join(F.broadcast(own), "term").collect()}
        windows.ordered(terms, np.array([got.get(t, 0) for t in terms.tolist()], np.int64))
        parts.append(search(segments, windows))
    hits = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items", "near")]
        hits = hits.groupBy("doc_id", "text_key", "n_words").agg(*lists, F.count("*").alias("rows"))
        hits = hits.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / len(parts)).cast("int"))))
    first = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    grow = lambda a, r: F.struct(F.greatest(a["upto"], r["ends"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), r["ends"] - F.greatest(a["upto"], r["starts"]))).alias("n"))
    n_hit = F.aggregate(F.array_sort(F.arrays_zip("starts", "ends")), first, grow, lambda a: a["n"])
    listed = F.array_sort(F.array_distinct(F.array_compact("items")))
    near = F.array_except(F.array_distinct(F.array_compact("near")), F.col("items"))
    out = hits.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), listed.alias("item_ids"), F.array_sort(near).alias("near_ids"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean_of(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark."""
    bad = contamination(docs, benchmark, size, slop=0).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_bad_id")) & (F.xxhash64(docs["text"]) == F.col("_bad_key")), "left_anti")


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    digest = lambda c: F.sha2(F.array_join(c, ",").cast("binary"), 256)
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest("item_ids").alias("items_sha256"), "contaminated",
        F.size("near_ids").cast("long").alias("n_near"), digest("near_ids").alias("near_sha256"),
    )


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM dw),
df AS (SELECT word, count(*) AS df FROM pos GROUP BY word),
ww AS (SELECT g, n, unnest(string_split(g, ' ')) AS word, unnest(generate_series(1, n)) AS j FROM (SELECT DISTINCT g, n FROM win)),
-- every word of a window that the corpus has, the rarest as its anchor
anchor AS (SELECT g, n, arg_min(ww.word, (coalesce(df, 0), j)) AS word, arg_min(j, (coalesce(df, 0), j)) AS at FROM ww LEFT JOIN df USING (word) GROUP BY g, n HAVING min(coalesce(df, 0)) > 0),
cand AS (SELECT a.g, a.n, p.doc_id, p.p - a.at + 1 AS start FROM anchor a JOIN pos p USING (word)),
near AS (SELECT c.g, c.doc_id, c.start FROM cand c JOIN ww USING (g) JOIN pos p ON p.doc_id = c.doc_id AND p.word = ww.word AND p.p BETWEEN c.start + ww.j - 3 AND c.start + ww.j + 1
  GROUP BY c.g, c.n, c.doc_id, c.start HAVING count(DISTINCT ww.j) = c.n),
q AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM near JOIN win USING (g) WHERE item_id IS NOT NULL
  EXCEPT SELECT doc_id, CAST(item_id AS VARCHAR) FROM m),
o AS (SELECT doc_id, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS near_list FROM q GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near, sha256(coalesce(near_list, '')) AS near_sha256
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN o USING (doc_id)
"""
