"""Token ids on disk, bit-packed.

A dataset is Parquet whose rows are runs of whole documents in ascending doc_id order. A run's ids are packed with
the fewest bits that the vocabulary needs, in blocks of BLOCK ids that each start on a byte; block offsets and document
ends are kept beside them, so that any document or range is found by arithmetic and unpacked by numpy at once.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm.shared import shared_dir

BLOCK = 4096
#: Ids that close a run; a single longer document makes a longer run.
RUN = 262_144
#: Distinct words whose ids a worker keeps, and texts that it encodes at a time.
CACHE, TEXTS = 500_000, 500
#: Bytes of text that a partition aims at.
PART_BYTES = 256_000_000

RUNS = "shard int, run int, first_doc long, bits int, doc_id array<long>, n_tokens array<int>, block_offset array<long>, packed binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> tuple[bytes, list[int]]:
    """Packed blocks, lowest bit first, and each block's byte offset with the end as last. An id that needs more bits is an error."""
    out, offsets, at = [], [0], 0
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} does not fit {bits} bits")
    for k in range(0, len(ids), BLOCK):
        block = ids[k : k + BLOCK]
        if bits in (8, 16, 32):
            raw = block.astype(f"<u{bits // 8}").tobytes()
        else:
            raw = np.packbits((block[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
        out.append(raw)
        offsets.append(at := at + len(raw))
    return b"".join(out), offsets


def unpack(packed: bytes, offsets: list[int], bits: int, start: int, end: int) -> np.ndarray:
    """Ids start to end of a run, from the blocks that hold them alone."""
    if end <= start:
        return np.zeros(0, np.uint32)
    first, last = start // BLOCK, (end - 1) // BLOCK
    parts = []
    for b in range(first, last + 1):
        raw = np.frombuffer(packed, np.uint8, offsets[b + 1] - offsets[b], offsets[b])
        if bits in (8, 16, 32):
            parts.append(raw.view(f"<u{bits // 8}").astype(np.uint32))
        else:
            n = len(raw) * 8 // bits
            parts.append(np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32)))
    return np.concatenate(parts)[start - first * BLOCK : end - first * BLOCK]


#: In Latin-1 a byte is a code point. Letters and number signs as the splitting pattern of the tokenizer sees them.
LETTERS = bytes(c for c in range(256) if chr(c).isalpha())
NUMBERS = bytes(c for c in range(256) if chr(c).isnumeric())
BLANK = b"\t\n\x0b\x0c\r \x85\xa0"
#: What the fast path leaves to the library: control characters, which pattern engines take for blanks or not.
ODD = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f-\x9f]|<\|")
SMALL = bytes(ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256))


#: Texts that tokenizers of another case, splitting or order of merging encode otherwise: cases, blanks, digits, signs, contractions, letters beside ASCII, ends of words.
PROBES = [
    "The QUICK brown Fox's  can't\n\nwe'll I'M", "A1b22 333,4444.5 $6 %7%%", "ÀÉÎõü ñandú STRASSE straße ÆØÅ", " leading and trailing ", "", "x", "Hello,world!!(ok)[no]{a}_b-c=d", "tab\tand\r\nreturn\xa0hard \x85 next", "¿Qué? «a» ±²³ ¼½ µm ª º",
    "internationalisation uncharacteristically antidisestablishmentarianism", "don't DON'T he'd they've o'clock 'quoted' ''", "http://a.b/c?d=e&f#g user@host.tld 10.0.0.1",
]


def _set(signs: bytes) -> bytes:
    return b"".join(re.escape(bytes([c])) for c in signs)


WORD = re.compile(b"'s|'t|'re|'ve|'m|'ll|'d|[" + _set(LETTERS) + b"]+|[" + _set(NUMBERS) + b"]|[^" + _set(LETTERS + NUMBERS + BLANK) + b"]+")


class Numbers(dict):
    """Numbers keys as they are first asked for and keeps the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Encoder:
    """Ids of whole texts by the library, each distinct word encoded once.

    Where the tokenizer lower-cases, splits into words and merges within a word, a text's ids are its words' ids in turn.
    Words are split here for Latin-1 texts alone, where case and classes are certain, and merged by the library's model; other
    texts go to the library whole. Whether a tokenizer is of that kind is tried on PROBES; with any other one, all texts go
    to the library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        # The model reads a word's UTF-8 bytes as the signs of its byte alphabet: visible Latin-1 as it is, the rest from 256 on.
        seen = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
        hidden = [b for b in range(256) if b not in seen]
        self.alphabet = {b: b for b in seen} | {b: 256 + i for i, b in enumerate(hidden)}
        self._clear()
        self.by_words = all(np.array_equal(x, self.library.encode(t, add_special_tokens=False).ids) for x, t in zip(self._encode(PROBES), PROBES, strict=True))

    def _clear(self) -> None:
        self.words, self.flat, self.ends = Numbers(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _merge(self) -> None:
        """Encodes the words that are new since the last call."""
        if new := self.words.new:
            model = self.library.model
            lists = [[t.id for t in model.tokenize(w.decode("latin-1").encode().decode("latin-1").translate(self.alphabet))] for w in new]
            self.flat = np.concatenate([self.flat, np.array([i for x in lists for i in x], np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in lists])])
            self.words.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.by_words:
            return self._encode(texts)
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHE:
            self._clear()
        found: list[np.ndarray | None] = []
        for text in texts:
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                found.append(None)
                continue
            words = None if ODD.search(raw) else WORD.findall(raw.translate(SMALL))
            found.append(None if words is None else np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        self._merge()
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if at is None else self._ids(at) for t, at in zip(texts, found, strict=True)]

    def _ids(self, at: np.ndarray) -> np.ndarray:
        n = self.ends[at + 1] - self.ends[at]
        return self.flat[np.repeat(self.ends[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, over all its tasks."""
    return Encoder(path)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, vocabulary: int) -> None:
    """Writes docs(doc_id, text) to out: each text's ids and end_id, in ascending doc_id order, nulls first.

    Documents are range-partitioned by doc_id, so shards are in order and of like size whatever source they are from; rows
    that share a doc_id are ordered by text. A null or empty text is its end id alone.
    """
    bits = bits_for(vocabulary)
    schema = pa.schema([("shard", pa.int32()), ("run", pa.int32()), ("first_doc", pa.int64()), ("bits", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("block_offset", pa.list_(pa.int64())), ("packed", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, run = TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            packed, offsets = pack(np.concatenate(ids), bits)
            values = (shard, run, doc_ids[0], bits, doc_ids, lengths, offsets, packed)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                encoded = encoder(tokenizer).encode([t or "" for t in part.column(1).to_pylist()])
                for doc_id, got in zip(part.column(0).to_pylist(), encoded, strict=True):
                    ids += [got, end]
                    doc_ids.append(doc_id)
                    lengths.append(len(got) + 1)
                    held += len(got) + 1
                    if held >= RUN:
                        yield row()
                        ids, doc_ids, lengths, held, run = [], [], [], 0, run + 1
        if doc_ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, RUNS).write.parquet(out)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. start counts the ids of all documents before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.array(r["n_tokens"], np.int64)
                ends = np.cumsum(lengths)
                ids = unpack(r["packed"], r["block_offset"], r["bits"], 0, int(ends[-1])).astype("<u4")
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(lengths)
                cols = [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["run"]] * n, pa.int32()), pa.array(r["doc_id"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "run", "doc_id", "at", "n_tokens", "ids_crc32"])

    runs = spark.read.parquet(path)
    # Three levels of sums: documents in a run, runs in a shard, shards. The last window has a row for each shard only.
    per_run = runs.select("shard", "run", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = per_run.groupBy("shard").agg(F.sum("n").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    places = per_run.select("shard", "run", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("run_start")).join(shards, "shard")
    docs = runs.mapInArrow(scan, "shard int, run int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["shard", "run"]).select("doc_id", (F.col("shard_start") + F.col("run_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of single documents, by random access: only their runs are read and only their blocks unpacked."""
    want = set(doc_ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = np.cumsum(r["n_tokens"])
                for d, n, e in zip(r["doc_id"], r["n_tokens"], ends.tolist(), strict=True):
                    if d in want:
                        ids = unpack(r["packed"], r["block_offset"], r["bits"], e - n, e)
                        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    runs = spark.read.parquet(path).where(F.arrays_overlap("doc_id", F.array(*[F.lit(d).cast("long") for d in doc_ids])))
    return runs.mapInArrow(scan, "doc_id long, ids array<long>")


def op4(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, out, tokenizer, end_id, vocabulary)
    return read_documents(spark, out)
