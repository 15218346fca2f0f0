"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces and a single Viterbi pass.

The automaton reads a text once; at each position its output links give every piece that ends there, and each relaxes the
best score of that position. For a unigram model the best score decides. For a BPE model a step is admissible only if the
piece stands beside the last one as merging would leave the two, which makes the admissible path the merge result itself.
No piece spans a line feed, or a space behind another sign, so texts are cut there and each distinct part is solved once.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct parts whose ids a worker keeps.
CACHE = 600_000
#: Signs that a normaliser would change: compatibility forms, runs of blanks, tabs, a soft hyphen.
PROBES = ("\uff21", "\ufb01", "\u2460", "  ", "\t", "\xad", "e\u0301", "\u00a0", "A")
#: A space run with the word behind it, a space run before a line feed or the end, or a line feed.
PART = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Parts(dict):
    """The ids of parts, as little-endian 32-bit bytes, solved when first met."""

    def __init__(self, solve):
        super().__init__()
        self.solve = solve

    def __missing__(self, part: str) -> bytes:
        self[part] = ids = np.array(self.solve(part), "<u4").tobytes()
        return ids


class PieceModel:
    """Pieces, scores and byte pieces of a model file, and the automaton over them."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        self.scores = [library.get_score(i) for i in range(n)]
        self.unknown = library.unk_id()
        self.special = {i for i in range(n) if library.is_control(i) or library.is_unknown(i) or library.is_unused(i)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if library.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(n) if i not in self.special and i not in byte_of]
        self.ids = {self.pieces[i]: i for i in plain}
        #: A merge model gives ever lower whole scores by rank; a unigram model has log probabilities.
        self.merges = all(float(self.scores[i]).is_integer() for i in plain)
        self.prefix = library.id_to_piece(library.encode("a")[0]).startswith(SPACE)
        self.penalty = min([self.scores[i] for i in plain], default=0.0) - 10
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that span words are not supported")
        for sign in PROBES:
            got = library.encode(f"a{sign}b")
            if self.unknown not in got and library.decode(got) != f"a{sign}b":
                raise ValueError("models that change texts before they cut them are not supported")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p) - 1, i, self.scores[i]))
        self.automaton.make_automaton()
        self.signs = frozenset(p for p in self.ids if len(p) == 1)
        #: What each piece decodes to.
        self.raw = [bytes([byte_of[i]]) if i in byte_of else " ⁇ ".encode() if i == self.unknown else b"" if i in self.special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        #: For each piece (-1: nothing, or a sign outside the pieces), which pieces may stand behind it.
        self.follow: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.n_follow = 0
        self.parts = Parts(self.solve)

    def merged(self, text: str) -> list[str]:
        """The merge rule on a short text: of adjacent parts whose union is a piece the best goes first, leftmost of equals."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = (self.scores[i], k)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def beside(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' signs leaves just these two; left -1: nothing, or a sign outside the pieces."""
        a, b = "" if left < 0 else self.pieces[left], self.pieces[right]
        known = self.merged(a + b) == ([a, b] if a else [b])
        self.n_follow += 1
        self.follow[left][right] = known
        return known

    def solve(self, part: str) -> list[int]:
        """Ids of a part: one pass of the automaton, best score and last piece for each position."""
        n, merges, follow = len(part), self.merges, self.follow
        if self.n_follow > 4 * CACHE:
            follow.clear()
            self.n_follow = 0
        score, last, size_of = [0.0] + [None] * n, [-1] * (n + 1), [1] * (n + 1)  # last: id of the piece that ends here; -1: a sign outside the pieces
        odd = not self.signs.issuperset(part)
        at = 0
        for end, (less, i, gain) in self.automaton.iter(part):
            if odd:
                while at < end:
                    at += 1
                    if part[at - 1] not in self.ids:
                        self._outside(score, last, size_of, at)
            start = end - less
            before = score[start]
            if before is None:
                continue
            if merges:
                known = follow[last[start]].get(i)
                if not (self.beside(last[start], i) if known is None else known):
                    continue
            end += 1
            total = before + gain
            if score[end] is None or total > score[end]:
                score[end], last[end], size_of[end] = total, i, less + 1
        if odd:
            for at in range(at + 1, n + 1):
                if part[at - 1] not in self.ids:
                    self._outside(score, last, size_of, at)
        out: list[int] = []
        while n:
            i = last[n]
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(part[n - 1].encode())]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            n -= size_of[n]
        return out[::-1]

    def _outside(self, score: list, last: list, size_of: list, at: int) -> None:
        """Relaxes a position by its one sign, which is no piece."""
        if score[at - 1] is not None and (score[at] is None or score[at - 1] + self.penalty > score[at]):
            score[at], last[at], size_of[at] = score[at - 1] + self.penalty, -1, 1

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the library's own encoder gives them for a model that keeps texts as they are."""
        if not text:
            return np.zeros(0, "<u4")
        if len(self.parts) > CACHE:
            self.parts.clear()
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self.parts.__getitem__, PART.findall(text))), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text again; bytes that are no UTF-8 come back as replacement signs."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def piece_model(path: str) -> PieceModel:
    """One for each worker process, over all its tasks."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of docs: doc_id, ids, n_pieces, ids_crc32 (of ids as little-endian 32-bit), round_trip.

    round_trip says that the ids decode to the text again; U+2581 in a text is the same as a space to the model and decodes as
    one. A null text has no ids. Repeated rows come back each; other columns are neither read nor returned.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):  # the ids of a whole batch would take many times its text
                part = batch.slice(k, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [m.encode(t) for t in texts]
                same = [m.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
                cols = [pa.array([x.view(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "ids", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids); null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for batch in batches:
            texts = [None if x is None else m.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def op7(docs: DataFrame, model: str) -> DataFrame:
    return encode_pieces(docs, model).drop("ids")
