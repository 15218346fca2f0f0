"""Suffix-array dedup: bytes that some 100-byte string covers which also starts earlier in the corpus.

Equal strings must meet in one shard of text. Each window of 100 bytes is therefore sent by its anchor, the window's 32-byte gram
of least hash: equal windows have equal anchors at equal places. Neighbouring windows of one anchor travel as one piece.
Only places travel at first; an anchor met once has no partner and goes no further. Copies of a piece enter once,
with their earliest place; the others are removed whole, most of them by the task that reads them. The pieces
that are left, with their text, make up the shards. A shard's suffixes are sorted with their common prefixes by external
induced sorting (see induced_sort), so it may be far larger than memory, and windows side by side with 100 bytes
in common are the repeats, all but the earliest.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.induced_sort import suffix_order
from barloom.llm.shared import stored

#: Bytes of an anchor's gram: 2 ** DOUBLINGS.
DOUBLINGS = 5
GRAM = 1 << DOUBLINGS
#: Bytes of text that are cut at a time, and places that a task compares among themselves before they travel.
CUT_BYTES, CUT_PLACES = 1 << 20, 1_000_000
#: Bytes of pieces that a shard aims at. It may be larger.
SHARD_BYTES = 2_000_000
#: Tuples a queue may hold in memory, and names that are sorted in memory.
QUEUE_TUPLES, NAMES_FIT = 1_000_000, 1_000_000
#: Bits of a place: start, number of windows, and a tag that tells texts apart which share a doc_id.
START_BITS, COUNT_BITS, TAG_BITS = 31, 7, 24
#: Bits of a piece's hash, which stand beside its anchor's 64.
SEG_BITS = 40

_U = np.uint64
_BASE, _OTHER = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
PLACES = "fp long, seg long, doc_id long, place long"


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(32))


#: A random number for each byte, by a rule.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _OTHER)


class Powers:
    """Powers of an odd base and of its inverse, as far as asked."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                size = max(n, CUT_BYTES + (CUT_BYTES >> 2))
                powers = [np.full(size, b, np.uint64) for b in (_BASE, _U(pow(int(_BASE), -1, 1 << 64)))]
                self.up, self.down = (np.multiply.accumulate(np.append(_U(1), p[1:])) for p in powers)
        return self.up, self.down


def anchored(t: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(start, n, fp, seg) of the pieces of texts t[begin:end]: windows start .. start + n - 1 share the anchor fp; seg is a hash of the whole piece."""
    span = size - GRAM + 1
    with np.errstate(over="ignore"):
        h, factor = BYTES[t], int(_BASE)
        one = h
        for k in range(DOUBLINGS):
            h = h[: len(h) - (1 << k)] * _U(factor) + h[1 << k :]
            factor = factor * factor & ((1 << 64) - 1)
        h = mix(h)
        at_bits = _U((1 << 23) - 1)
        least, width = (h & ~at_bits) | np.arange(len(h), dtype=np.uint64), 1
        while width * 2 <= span:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least & at_bits).astype(np.int64)
        fits = end - begin >= size
        begin, last = begin[fits], end[fits] - size
        start = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, begin)
        text = np.searchsorted(begin, start, "right") - 1
        inside = (text >= 0) & (start <= last[text])
        stop = np.minimum(np.append(start[1:], len(anchor)) - 1, last[text])[inside]
        start = start[inside]
        n = stop - start + 1
        up, down = powers.upto(len(t) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * up[: len(t)])])
        body = (total[stop + size] - total[start]) * down[start]
        seg = mix(body + n.astype(np.uint64) * _BASE + (anchor[start] - start).astype(np.uint64) * _OTHER) >> _U(64 - SEG_BITS)
    return start, n, h[anchor[start]].view(np.int64), seg.view(np.int64)


def firsts(fp: np.ndarray, seg: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Order by (fp, seg, doc, place), and whether each is the first of its piece in that order."""
    order = np.lexsort((place, doc, seg, fp))
    a, b = fp[order], seg[order]
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))


def span_rows(doc: np.ndarray, place: np.ndarray, size: int) -> pa.RecordBatch:
    """Rows of PLACES that stand for removed bytes: seg is the end, the place has no windows. Neighbours are joined."""
    if not len(doc):
        return place_rows(doc, doc, doc, doc)
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    n = place & ((1 << COUNT_BITS) - 1)
    head = place >> COUNT_BITS
    begin = head & ((1 << START_BITS) - 1)
    end = begin + n - 1 + size
    new = np.append(True, (doc[1:] != doc[:-1]) | (head[1:] - begin[1:] != head[:-1] - begin[:-1]) | (begin[1:] > end[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return place_rows(mix(doc[first].view(np.uint64)).view(np.int64), end[last], doc[first], head[first] << COUNT_BITS)


def place_rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["fp", "seg", "doc_id", "place"])


def cut_places(docs: DataFrame, size: int) -> DataFrame:
    """PLACES of the pieces of docs(doc_id, tag, text binary), and spans of copies that a task has found by itself."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, texts, held = Powers(), [], 0
        kept: list[tuple[np.ndarray, ...]] = []

        def pieces() -> tuple[np.ndarray, ...]:
            t = np.frombuffer(b"".join(x for *_, x in texts), np.uint8)
            end = np.cumsum([len(x) for *_, x in texts])
            begin = end - np.array([len(x) for *_, x in texts])
            start, n, fp, seg = anchored(t, begin, end, size, powers)
            of = np.searchsorted(begin, start, "right") - 1
            # Empty texts share a begin with the next one; the last of them is the one with bytes.
            doc = np.array([d for d, *_ in texts], np.int64)[of]
            head = np.array([g << START_BITS | s for _, g, s, _ in texts], np.int64)[of]
            return fp, seg, doc, ((head + start - begin[of]) << COUNT_BITS) | n

        def flush() -> Iterator[pa.RecordBatch]:
            fp, seg, doc, place = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            order, first = firsts(fp, seg, doc, place)
            own, copy = order[first], order[~first]
            yield place_rows(fp[own], seg[own], doc[own], place[own])
            if len(copy):
                yield span_rows(doc[copy], place[copy], size)

        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for at in range(0, max(1, len(raw) - size + 1), CUT_BYTES):
                    part = raw[at : at + CUT_BYTES + size - 1] if len(raw) > CUT_BYTES else raw
                    if len(part) < size:
                        continue
                    texts.append((doc, tag, at, part))
                    held += len(part)
                    if held >= CUT_BYTES:
                        kept.append(pieces())
                        texts, held = [], 0
                        if sum(len(x[0]) for x in kept) >= CUT_PLACES:
                            yield from flush()
        if texts:
            kept.append(pieces())
        if kept:
            yield from flush()

    return docs.mapInArrow(cut, PLACES)


def matched(places: DataFrame, size: int, partitions: int) -> DataFrame:
    """PLACES that need a look at their text: the earliest place of each piece whose anchor has two or more pieces. And all spans.

    Rows come sorted by anchor and piece and are read as a stream, so an anchor's number of rows costs no memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        alone: np.ndarray | None = None
        for batch in batches:
            fp, seg, doc, place = (c.to_numpy() for c in batch.columns)
            span = (place & ((1 << COUNT_BITS) - 1)) == 0
            if span.any():
                yield place_rows(fp[span], seg[span], doc[span], place[span])
                fp, seg, doc, place = (x[~span] for x in (fp, seg, doc, place))
            if not len(fp):
                continue
            new_fp = np.append(last[0] is None or fp[0] != last[0], fp[1:] != fp[:-1])
            new = new_fp | np.append(last[1] is None or seg[0] != last[1], seg[1:] != seg[:-1])
            if not new.all():
                yield span_rows(doc[~new], place[~new], size)
            # Firsts by anchor; the one before this batch counts with its anchor's.
            group = np.cumsum(new_fp)
            many = np.bincount(group[new], minlength=group[-1] + 1)
            carried = many[0]
            many[0] += last[0] is not None
            if carried and alone is not None:
                yield place_rows(*alone)
            out = new & (many[group] > 1)
            if out.any():
                yield place_rows(fp[out], seg[out], doc[out], place[out])
            last = (fp[-1], seg[-1])
            if group[-1] or carried:
                f = np.flatnonzero(new & (group == group[-1]))
                alone = tuple(x[f] for x in (fp, seg, doc, place)) if many[group[-1]] == 1 else None

    dealt = places.repartition(partitions, "fp").sortWithinPartitions("fp", "seg", "doc_id", "place")
    return stored(dealt.mapInArrow(read, PLACES), "suffix-places")


def scratch_dir() -> str:
    """Where a task keeps the files of its queues while it runs: beside Spark's own spill files."""
    return os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]


def shard_spans(pieces: DataFrame, size: int, shards: int, queue_tuples: int = QUEUE_TUPLES, names_fit: int = NAMES_FIT) -> DataFrame:
    """PLACES spans of the windows that repeat an earlier one, of pieces(fp, doc_id, place, body): one shard a partition.

    The shard's text goes to a file as it comes, and so do queues, names and suffixes. Two arrays stay in memory: the
    pieces' places and a byte for each of the shard's.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(scratch_dir(), exist_ok=True)
        with tempfile.TemporaryDirectory(prefix="shard-", dir=scratch_dir()) as folder:
            path, begins, docs, places, upto, last = os.path.join(folder, "text"), [], [], [], 0, None
            with open(path, "wb") as out:
                for batch in batches:
                    doc, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    # Rows that share doc_id and text are one document: their pieces come behind each other.
                    same = np.append(last == (doc[0], place[0]), (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])) if len(doc) else np.zeros(0, bool)
                    last = (doc[-1], place[-1]) if len(doc) else last
                    bodies = [b.as_buffer().to_pybytes() for b, again in zip(batch.column(2), same.tolist(), strict=True) if not again]
                    for b in bodies:
                        begins.append(upto)
                        upto += len(b) + 1
                    t = np.frombuffer(b"".join(b + b"\0" for b in bodies), np.uint8).astype(np.uint16) + 2
                    ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
                    t[ends.astype(np.int64)] = 1
                    t.tofile(out)
                    docs.append(doc[~same])
                    places.append(place[~same])
                np.zeros(1, np.uint16).tofile(out)
            if not begins:
                return
            text = np.memmap(path, np.uint16, "r")
            begin, doc, place = np.array(begins), np.concatenate(docs), np.concatenate(places)
            n = place & ((1 << COUNT_BITS) - 1)
            valid = np.zeros(len(text), bool)
            valid[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())] = True
            later = repeats(suffix_order(text, 258, os.path.join(folder, "order"), queue_tuples, names_fit), valid, size)
            run = np.diff(np.concatenate([[False], later, [False]]).astype(np.int8))
            start, stop = np.flatnonzero(run == 1), np.flatnonzero(run == -1)
            of = np.searchsorted(begin, start, "right") - 1
            del text
        yield span_rows(doc[of], (((place[of] >> COUNT_BITS) + start - begin[of]) << COUNT_BITS) | (stop - start), size)

    dealt = pieces.repartition(shards, "fp").select("doc_id", "place", "body").sortWithinPartitions("doc_id", "place")
    return dealt.mapInArrow(sort, PLACES)


def repeats(order: Iterator[tuple[np.ndarray, np.ndarray]], valid: np.ndarray, size: int) -> np.ndarray:
    """Whether a valid window of size bytes starts at each place that an earlier place starts too.

    In order of suffixes, neighbours with so long a common prefix are equal windows. least is the earliest of the window
    that the last part ended in, as far as it was read.
    """
    later = np.zeros(len(valid), bool)
    least = -1
    for place, lcp in order:
        group = np.cumsum(lcp < size)
        last = int(group[-1])
        if group[0]:
            least = -1
        use = valid[place]
        place, group = place[use], group[use]
        if len(place):
            cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            low = np.minimum.reduceat(place, cut)
            if group[0] == 0 and least >= 0:
                later[max(least, int(low[0]))] = True
                low[0] = min(least, int(low[0]))
            low_of = np.repeat(low, np.diff(np.append(cut, len(place))))
            later[place[place > low_of]] = True
            least = int(low[-1]) if group[-1] == last else -1
        elif last:
            least = -1
    return later


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag and text as bytes of each row with a doc_id. Where ids repeat, the tag is a hash of the text, else 0."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.where(F.col("doc_id").isNotNull())
    once = rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    tag = F.lit(0).cast("long") if once else F.xxhash64("text").bitwiseAND(F.lit((1 << TAG_BITS) - 1))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), raw.alias("body"))


def repeated_spans(rows: DataFrame, size: int, shard_bytes: int) -> DataFrame:
    """(doc_id, tag, start, end): spans of bytes, end exclusive, of tagged rows that equal strings of size bytes cover which start earlier; spans may overlap."""
    if not GRAM + 1 <= size <= GRAM - 1 + (1 << COUNT_BITS) - 1:
        raise ValueError(f"size must be from {GRAM + 1} to {GRAM + (1 << COUNT_BITS) - 2}")
    places = matched(cut_places(rows, size), size, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    is_span = F.col("place").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)) == 0
    start = F.shiftright("place", COUNT_BITS).bitwiseAND(F.lit((1 << START_BITS) - 1))
    tag = F.shiftright("place", COUNT_BITS + START_BITS)
    pieces = places.where(~is_span)
    spans = places.where(is_span)
    if total := pieces.count() * (size + 25):
        ask = pieces.select("doc_id", tag.alias("tag"), "fp", "place")
        length = F.col("place").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)) - 1 + size
        body = F.substring("body", (start + 1).cast("int"), length.cast("int"))
        with_text = rows.join(ask, ["doc_id", "tag"]).select("fp", "doc_id", "place", body.alias("body"))
        spans = spans.unionByName(shard_spans(with_text, size, max(1, -(-total // shard_bytes))))
    return spans.select("doc_id", tag.alias("tag"), start.alias("start"), F.col("seg").alias("end"))


def suffix_dedup(docs: DataFrame, size: int = 100, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte goes if a string of size bytes covers it that also starts earlier: in a smaller doc_id, or earlier in the same
    document. A null or empty text has no bytes. Rows that share a doc_id and text are one document and lose the same
    bytes; of different texts that share one, order goes by a hash. Rows without doc_id are compared with nothing and stay
    whole. Other columns are neither read nor returned. A text may have up to 2 GB. Copies of a piece are told by 104 bits of
    two hashes. Texts are shuffled once: cutting out pieces and removing bytes share the exchange.
    """
    rows = tagged(docs)
    spans = repeated_spans(rows, size, shard_bytes).groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = rows.join(spans, ["doc_id", "tag"], "left").select("doc_id", "body", "starts", "ends")
    lone = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    joined = joined.unionByName(lone, allowMissingColumns=True)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, start, end in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = text.as_buffer().to_pybytes()
                if not start.is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                a, b = np.sort(start.values.to_numpy()), np.sort(end.values.to_numpy())
                new = np.append(True, a[1:] > b[:-1])
                a, b = a[new], b[np.append(new[1:], True)]
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(a), kept))
            n, gone, runs, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, gone, runs)], pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op13(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
