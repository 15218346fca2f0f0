"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through rank-RANK factors; a score takes linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]. It learns from a bounded sample of labelled
rows (per_class rows of each class); scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import held_out, label_sample

#: Buckets of hashed words, rank of the interactions, bins of each statistic.
WORDS, RANK, BINS = 2048, 8, 8
STATS = ("chars", "words", "word_length", "ascii_letters", "upper", "digits", "signs", "bars", "distinct_words", "lines", "distinct_lines", "line_length", "top_word", "sign_words", "short_lines", "listed_chars")
SIZE = WORDS + len(STATS) * BINS
CACHE = 400_000

_KIND = np.zeros((256, 5), np.float32)
for _c in range(256):
    _KIND[_c, 0] = 65 <= _c <= 90 or 97 <= _c <= 122
    _KIND[_c, 1] = 65 <= _c <= 90
    _KIND[_c, 2] = 48 <= _c <= 57
    _KIND[_c, 3] = 33 <= _c <= 47 or 58 <= _c <= 64 or 91 <= _c <= 96 or 123 <= _c <= 126
    _KIND[_c, 4] = _c == 124


class Features:
    """Word buckets and structure statistics of a text."""

    def __init__(self):
        self.buckets: dict[bytes, int] = {}

    def of(self, text: bytes, listed_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(bucket counts as shares of unit length, statistics)."""
        words = text.lower().split()
        known = self.buckets
        if len(known) > CACHE:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w) % WORDS
        counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=WORDS).astype(np.float32)
        counts = np.log1p(counts)
        norm = float(np.sqrt((counts**2).sum()))
        kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float32) @ _KIND / max(1, len(text))
        lines = text.split(b"\n")
        n, tally = len(words), Counter(words)
        top = max(tally.values(), default=0)
        odd = sum(k for w, k in tally.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,")
        short = sum(len(x) < 30 for x in lines)
        stats = np.array([np.log1p(len(text)), np.log1p(n), len(text) / max(1, n), *kinds, len(tally) / max(1, n), np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), top / max(1, n), odd / max(1, n), short / len(lines), np.log1p(max(0, listed_chars or 0))], np.float32)
        return counts / max(norm, 1e-6), stats


class Machine:
    """The model: bin edges of statistics, bias, weights and factors."""

    def __init__(self, edges: np.ndarray):
        self.edges, self.bias = edges, 0.0
        self.w, self.v = np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32)

    def matrix(self, counts: np.ndarray, stats: np.ndarray) -> np.ndarray:
        x = np.zeros((len(counts), SIZE), np.float32)
        x[:, :WORDS] = counts
        for s in range(len(STATS)):
            x[np.arange(len(x)), WORDS + s * BINS + np.searchsorted(self.edges[s], stats[:, s])] = 0.5
        return x

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.w + 0.5 * (((x @ self.v) ** 2).sum(1) - (x**2) @ (self.v**2).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x).astype(np.float64), -30, 30)))


def fit(counts: np.ndarray, stats: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """AdaGrad on the logistic loss, classes weighted alike; the same result for the same rows, in any order."""
    order = np.lexsort((stats[:, 0], counts @ np.arange(WORDS, dtype=np.float32), y)) if len(y) else np.zeros(0, int)
    counts, stats, y = counts[order], stats[order], y[order]
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(y) else np.zeros((len(STATS), BINS - 1))
    m = Machine(np.ascontiguousarray(edges))
    if len(set(y.tolist())) < 2:
        return m
    rng = np.random.default_rng(7)
    m.v = rng.normal(0, 0.05, m.v.shape).astype(np.float32)
    gw, gv, gb = np.full(SIZE, 1e-4, np.float32), np.full(m.v.shape, 1e-4, np.float32), 1e-4
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())).astype(np.float32)
    for _ in range(epochs):
        turn = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            at = turn[k : k + batch]
            x = m.matrix(counts[at], stats[at])
            e = ((m.score(x) - y[at]) * weight[at]).astype(np.float32) / len(at)
            xv = x @ m.v
            dv = x.T @ (e[:, None] * xv) - m.v * ((x**2).T @ e)[:, None] + decay * m.v
            dw, db = x.T @ e + decay * m.w, float(e.sum())
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= rate * dv / np.sqrt(gv)
            m.bias -= rate * db / gb**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Machine:
    """Learns `quality` from at most per_class rows of each class; features of the sample alone reach the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for batch in batches:
            rows = [f.of(t.as_buffer().to_pybytes() if t.is_valid else b"", n) for t, n in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            at = [np.flatnonzero(c).astype(np.int32) for c, _ in rows]
            cols = [batch.column(0), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([c[x].tobytes() for (c, _), x in zip(rows, at, strict=True)], pa.binary()), pa.array([s.tobytes() for _, s in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["y", "at", "value", "stats"])

    sample = label_sample(with_chars(docs), labels, "quality", per_class, "n_chars")
    rows = sample.select("y", F.col("text").cast("binary"), "n_chars").mapInArrow(features, "y int, at binary, value binary, stats binary").toPandas()
    counts = np.zeros((len(rows), WORDS), np.float32)
    for i, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        counts[i, np.frombuffer(at, np.int32)] = np.frombuffer(value, np.float32)
    stats = np.array([np.frombuffer(x, np.float32) for x in rows["stats"]], np.float32).reshape(len(rows), len(STATS))
    return fit(counts, stats, rows["y"].to_numpy())


def with_chars(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, n_chars); a table without n_chars has the texts' own lengths."""
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.char_length("text").cast("long")
    return docs.select("doc_id", "text", chars.alias("n_chars"))


def score_quality(docs: DataFrame, model: Machine) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from 0.5 on).

    Null counts as empty and is scored by its statistics like any text. doc_id, lang and source are no inputs. Repeated rows
    come back each. A model that learned from fewer than two classes scores 0.5 for all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, f = shared.value, Features()
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [f.of(t.as_buffer().to_pybytes() if t.is_valid else b"", n) for t, n in zip(part.column(1), part.column(2).to_pylist(), strict=True)]
                out.append(m.score(m.matrix(np.stack([c for c, _ in rows]), np.stack([s for _, s in rows]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    rows = with_chars(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "n_chars")
    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, train(docs, labels))
