"""Toxicity by a weighted finite-state pattern grammar over clauses.

An automaton over the lexicon finds clauses that hold an insult or a threat; only these are read by the grammar. Small
transducers, one each for insult, threat, target, named target, negation and reported speech, read a clause's word classes;
they are composed into one machine whose joint states are made as they are met. A clause matches where an insult or a threat
has someone or something in the same clause that it is said of: a pronoun, an article with a noun, or a noun that the insult
stands before. A word that stands alone, or with its own article only ("the idiot"), matches nothing and weighs nothing. A match's weight depends on its whole
mark (what, of whom, denied, quoted), and a text's score on the sum over its clauses. Insult entries are words and stems that
labelled rows of the training fold favour; the weights of marks are fitted on them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import held_out, label_sample, stored

#: Words of the closed classes, in the languages at hand.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting")
THREATS = ("kill", "murder", "hurt", "destroy", "töten", "umbringen", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "he", "she", "they", "him", "her", "them", "this", "du", "dich", "sie", "er", "tu", "toi", "vous", "il", "elle", "usted", "él", "ella")
ARTICLES = ("the", "a", "an", "that", "these", "those", "my", "der", "die", "das", "den", "dem", "ein", "eine", "le", "la", "les", "un", "une", "des", "ce", "cette", "el", "los", "las", "una")
NEGATIONS = ("not", "no", "never", "isn't", "nicht", "kein", "nie", "pas", "jamais", "nunca", "sin")
REPORTS = ("said", "says", "wrote", "quoted", "called", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")

WORD = re.compile(r"[\w']+|[\"“”„«»]")
CLAUSE = re.compile(r"[.!?;:\n]+")
STEMS = (4, 5, 6)
#: Class symbols of the grammar's input.
INSULT, THREAT, TARGET, ARTICLE, NEGATION, REPORT, OTHER = "ITYANRO"


class Transducer:
    """A deterministic machine over class symbols: step gives the next state and whether the mark holds at this word."""

    def __init__(self, start: int, step):
        self.start, self.step = start, step


def within(symbols: str, reach: int) -> Transducer:
    """Holds for reach words behind one of the symbols. States count the words since, reach + 1 for none."""
    return Transducer(reach + 1, lambda s, c: (0 if c in symbols else min(s + 1, reach + 1), s <= reach - 1 or c in symbols))


def since(symbols: str) -> Transducer:
    """Holds from one of the symbols to the clause's end."""
    return Transducer(0, lambda s, c: (1 if c in symbols else s, s == 1))


def just_after(symbol: str) -> Transducer:
    """Holds at a word that stands right behind the symbol."""
    return Transducer(0, lambda s, c: (1 if c == symbol else 0, s == 1))


def pair(first: str, second: str) -> Transducer:
    """Holds from the place where the two symbols have stood beside each other, in this order, to the clause's end."""

    def step(s: int, c: str) -> tuple[int, bool]:
        to = 2 if s == 2 or s == 1 and c == second else 1 if c == first else 0
        return to, to == 2

    return Transducer(0, step)


def matches(symbol: str) -> Transducer:
    return Transducer(0, lambda s, c: (0, c == symbol))


class Composed:
    """Several transducers over one input as one machine; a joint state's moves are made when first met."""

    def __init__(self, parts: list[Transducer]):
        self.parts, self.start = parts, tuple(p.start for p in parts)
        self.moves: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], tuple[bool, ...]]] = {}

    def run(self, classes: list[str]) -> list[tuple[bool, ...]]:
        state, out = self.start, []
        for c in classes:
            move = self.moves.get((state, c))
            if move is None:
                both = [p.step(s, c) for p, s in zip(self.parts, state, strict=True)]
                move = self.moves[state, c] = tuple(x for x, _ in both), tuple(x for _, x in both)
            state = move[0]
            out.append(move[1])
        return out


def grammar() -> tuple[Composed, Composed]:
    """The forward machine (insult, threat, target and named target before, negation, reported speech) and the backward one (targets behind)."""
    forward = [matches(INSULT), matches(THREAT), since(TARGET), pair(ARTICLE, OTHER), within(NEGATION, 2), since(REPORT)]
    return Composed(forward), Composed([since(TARGET), pair(OTHER, ARTICLE), just_after(OTHER)])


@dataclass
class Model:
    """entries: word or stem* -> weight; marks: weight of each mark (threat, at a pronoun, negated, reported) by its bits."""

    entries: dict[str, float]
    bias: float = -3.0
    marks: np.ndarray = field(default_factory=lambda: np.full(16, 1.0))

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + x @ self.marks, -30, 30))))


class Reader:
    """Reads texts by the grammar."""

    def __init__(self, model: Model):
        self.model, (self.forward, self.backward) = model, grammar()
        self.classes = dict.fromkeys(ARTICLES, ARTICLE) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(THREATS, THREAT) | dict.fromkeys('"“”„«»', REPORT)
        self.hints = ahocorasick.Automaton()
        for w in {*(e.rstrip("*") for e in model.entries), *THREATS}:
            self.hints.add_word(w, w)
        self.hints.make_automaton()

    def weight(self, word: str) -> float:
        """The insult weight of a word: that of its most specific entry; 0 for none."""
        return next((w for e in entries_of(word) if (w := self.model.entries.get(e))), 0.0)

    def read(self, text: str) -> np.ndarray:
        """Sums over matched clauses by mark: insult weights, and 3 for each targeted threat, dampened by log1p. Linear in the text."""
        x = np.zeros(16)
        if not self.hints.__len__():
            return x
        lower = text.lower()
        done = 0  # clauses before this place are read, so no sign is looked for there again
        for end, _ in self.hints.iter(lower):
            if end < done:
                continue
            start = max(done, *(lower.rfind(s, done, end) + 1 for s in ".!?;:\n"))
            m = CLAUSE.search(lower, end)
            done = m.start() if m else len(lower)
            self.clause(lower[start:done], x)
        return np.log1p(x)

    def clause(self, clause: str, x: np.ndarray) -> None:
        words = WORD.findall(clause)
        weights = [self.weight(w) for w in words]
        classes = [INSULT if k else self.classes.get(w, OTHER) for w, k in zip(words, weights, strict=True)]
        if INSULT not in classes and THREAT not in classes:
            return
        behind = self.backward.run(classes[::-1])[::-1]
        for (insult, threat, before, named, denied, reported), (after, called, noun), w in zip(self.forward.run(classes), behind, weights, strict=True):
            aimed = before or after
            if insult and (aimed or named or called or noun) or threat and aimed:
                x[8 * threat + 4 * aimed + 2 * denied + reported] += w if insult else 3.0


def entries_of(word: str) -> list[str]:
    """A word's lexicon entries, the most specific first: itself, then its stems."""
    return [word, *(word[:n] + "*" for n in sorted(STEMS, reverse=True) if len(word) > n)]


def favour(k1: int, k0: int, n1: int, n0: int) -> float:
    """How much toxic rows favour an entry that k1 of n1 toxic and k0 of n0 clean rows hold: log odds less 1.64 standard errors."""
    odds = np.log((k1 + 0.5) / (n1 + 1)) - np.log((k0 + 0.5) / (n0 + 1))
    return float(odds - 1.64 * np.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5)))


def induce(sample: DataFrame, support: int = 6, least: float = 1.6) -> dict[str, float]:
    """Insult entries: words, then ever shorter stems of the words that no entry holds yet, that toxic rows favour by `least`.

    A row that nearly copies another of the sample (same least shingle hash) counts once. An entry must stand in `support`
    toxic rows, and one in a hundred. Rows are of the bounded sample alone; all its words are compared.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted({w for w in WORD.findall((t or "").lower()) if len(w) > 3}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1)], names=["words", "y"])

    once = sample.groupBy("y", "sketch").agg(F.max("text").alias("text"))
    sizes = {r.y: r.n for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
    support = max(support, n1 // 100)
    rows = once.select("text", "y").mapInArrow(distinct, "words array<string>, y int").withColumn("row", F.monotonically_increasing_id())
    seen = stored(rows.select("row", "y", F.explode("words").alias("word")), "sample-words")
    chosen: dict[str, float] = {}
    for n in (None, *sorted(STEMS, reverse=True)):
        free = seen.where(~F.col("word").isin(*[e for e in chosen if not e.endswith("*")]))
        for k in STEMS:
            if stems := [e[:-1] for e in chosen if len(e) == k + 1 and e.endswith("*")]:
                free = free.where(~F.substring("word", 1, k).isin(*stems))
        entry = F.col("word") if n is None else F.concat(F.substring("word", 1, n), F.lit("*"))
        held = free.where(F.length("word") > (n or 0)).select("row", "y", entry.alias("entry")).distinct()
        counts = held.groupBy("entry").agg(F.count_if(F.col("y") == 1).alias("k1"), F.count_if(F.col("y") == 0).alias("k0")).where(F.col("k1") >= support)
        weights = {r.entry: favour(r.k1, r.k0, n1, n0) for r in counts.collect()}
        chosen |= {e: min(4.0, w) for e, w in weights.items() if w >= least}
    return chosen


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model:
    """Learns `toxic` from at most per_class rows of each class of the training fold."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column(0).to_pylist():
                w = (text or "").lower().encode().split()
                least.append(min((xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64())], names=["text", "y", "sketch"])

    sample = stored(label_sample(docs, labels, "toxic", per_class).select("text", "y").mapInArrow(sketch, "text string, y int, sketch long"), "label-sample")
    model = Model(dict.fromkeys(INSULTS, 2.0))
    model.entries |= induce(sample)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reader.read(t or "").tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = sample.select("text", "y").mapInArrow(marks, "x array<double>, y int").collect()
    x, y = np.array([r.x for r in rows]).reshape(len(rows), 16), np.array([r.y for r in rows], float)
    if len(set(y.tolist())) == 2:
        fit(model, x, y)
    return model


def fit(model: Model, x: np.ndarray, y: np.ndarray, decay: float = 5e-4, steps: int = 3000) -> None:
    """Logistic regression by gradient steps; weights start at 1 and none falls below 0, so no mark speaks for a text."""
    b, w, order = model.bias, model.marks.copy(), np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(b + x @ w, -30, 30))) - y
        b -= 0.5 * e.mean()
        w = np.maximum(0, w - 0.5 * (x.T @ e / len(y) + decay * (w - 1)))
    model.bias, model.marks = float(b), w


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from the threshold on).

    Null counts as empty; a text without a matched clause has the bias alone as its score. Repeated rows come back each.
    doc_id, lang and source are no inputs. Without labels of both classes the fixed words and weights serve.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m)
        for batch in batches:
            out = [m.score(reader.read(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def civil(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([reader.model.score(reader.read(t.as_py() or "")) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, train(docs, labels))
