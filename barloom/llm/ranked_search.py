"""Ranked lexical search, reversed: the items are indexed and the documents are the stream.

An inverted index over the items' terms is broadcast in blocks of bounded size. Each document's term counts run through it once
a block; every task keeps a heap of the k best documents for each item and nothing else. The heaps of all
tasks are merged in two steps, so that no task sees all of them. Texts are read once: what is kept of them is the counts of
terms that a 1 MB filter of the items' terms lets pass, and from that table come the corpus statistics too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.decontaminate import CACHE, Terms, term_filter, term_of, words
from barloom.llm.shared import stored

#: Pairs of item and term that one broadcast index may hold, at some 20 bytes each.
BLOCK_PAIRS = 1_000_000
#: Cells of item by document, and postings, that are scored at a time.
AT_ONCE = 2_000_000
#: Groups in which the tasks' heaps are merged before the last merge.
MERGERS = 64

COUNTS = "doc_id long, n_terms long, terms array<long>, counts array<int>"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): each item's distinct terms. Rows that share an id are one item; those without an id or a term are none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({term_of(w) for w in words(t.as_buffer().to_pybytes() if t.is_valid else None)}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "terms"])

    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(cut, "item_id long, terms array<long>")
    return stored(found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0), "search-items")


def term_counts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """COUNTS of each row with a doc_id: how many terms its whole text has, and how often each that passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(np.unpackbits(shared.value).astype(bool))
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column(1):
                w = words(text.as_buffer().to_pybytes() if text.is_valid else None)
                if len(known) > CACHE:
                    known.clear()
                t, n = np.unique(np.fromiter(map(known.__getitem__, w), np.int64, len(w)), return_counts=True)
                first = int(len(t) > 0 and t[0] == 0)
                lengths.append(len(w))
                terms.append(t[first:])
                counts.append(n[first:].astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, terms)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.zeros(0, kind)]).astype(kind))) for x, kind in ((terms, np.int64), (counts, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n_terms", "terms", "counts"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(count, COUNTS), "search-counts")


class Index:
    """Inverted index of a block of items: ascending terms, their weights, and the items that hold each."""

    def __init__(self, ids: list[int], terms: list[list[int]]):
        self.ids = np.array(ids, np.int64)
        pairs = np.concatenate([np.array(t, np.int64) for t in terms])
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in terms])
        order = np.argsort(pairs, kind="stable")
        self.items = owner[order]
        self.terms, first = np.unique(pairs[order], return_index=True)
        self.item_at = np.append(first, len(pairs)).astype(np.int64)

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Heaps:
    """For each item the k best documents so far: highest score first, then least doc_id."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items)
        self.item, self.doc, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def push(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        item, doc, score = (np.concatenate(x) for x in ((self.item, item), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        keep = nth < self.k
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]
        full = nth == self.k - 1
        self.floor[item[full]] = score[full]


def scored(index: Index, counts: pa.RecordBatch, n_docs: int, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(doc_ids, scores by item and document) of a few documents at a time.

    Scores are sums of whole numbers below 2**53, so doubles hold them exactly.
    """
    ids = counts.column(0).to_numpy()
    length = counts.column(1).to_numpy()
    lists = counts.column(2)
    size = np.diff(lists.offsets.to_numpy())
    term, tf = lists.flatten().to_numpy(), counts.column(3).flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), size)
    m = 100 - 90 + 90 * length * n_docs // max(n_terms, 1)
    at = np.minimum(np.searchsorted(index.terms, term), len(index.terms) - 1)
    hit = index.terms[at] == term
    at, tf, doc = at[hit], tf[hit], doc[hit]
    value = index.weights[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    many = index.item_at[at + 1] - index.item_at[at]
    work = np.cumsum(np.bincount(doc, many, len(ids)) + len(index.ids))
    low = 0
    while low < len(ids):
        high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + AT_ONCE, "right")))
        a, b = np.searchsorted(doc, (low, high))
        n = many[a:b]
        which = np.repeat(index.item_at[at[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = index.items[which].astype(np.int64) * (high - low) + np.repeat(doc[a:b] - low, n)
        yield ids[low:high], np.bincount(cell, np.repeat(value[a:b], n).astype(np.float64), len(index.ids) * (high - low)).reshape(len(index.ids), high - low)
        low = high


def best_of(counts: DataFrame, index: Index, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the heaps of all tasks over a block of items."""
    shared = counts.sparkSession.sparkContext.broadcast(index)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        heaps = Heaps(len(index.ids), k)
        for batch in batches:
            for ids, score in scored(index, batch, n_docs, n_terms):
                item, at = np.nonzero(score >= heaps.floor[:, None])
                if len(item):
                    heaps.push(item, ids[at], score[item, at].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (index.ids[heaps.item], heaps.doc, heaps.score)], names=["item_id", "doc_id", "score"])

    return counts.mapInArrow(stream, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents that score highest, among all with a score above 0.

    Terms are runs of 0-9, a-z and non-ASCII after lower-casing A-Z; a null or empty text has none. Documents count in the
    statistics where they have a term. Rows without doc_id are left out of all; repeated rows of one doc_id are documents of
    their own and may both be ranked. Items that share an id are one, with all their terms; items without id or
    terms have no rows, and so has an empty table on either side. Equal scores go by doc_id. Other columns are neither read nor
    returned. An item's distinct terms must fit one block.
    """
    spark = docs.sparkSession
    known = item_terms(items)
    counts = term_counts(docs, term_filter(known))
    n_docs, n_terms = counts.where("n_terms > 0").agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = stored(counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "search-df")
    pairs = known.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(pairs / block_pairs))
    parts = [spark.createDataFrame([], "item_id long, doc_id long, score long")]
    for b in range(n_blocks):
        block = known.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect()
        if block and n_docs:
            index = Index([r.item_id for r in block], [r.terms for r in block])
            own = spark.createDataFrame(pa.table({"term": index.terms}))
            got = {r.term: r.df for r in df.join(F.broadcast(own), "term").collect()}
            index.weigh(np.array([got.get(t, 0) for t in index.terms.tolist()], np.int64), n_docs)
            parts.append(best_of(counts, index, n_docs, n_terms, k))
    found = reduce(DataFrame.unionByName, parts).withColumn("merger", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
    order = [F.desc("score"), F.col("doc_id")]
    first = found.withColumn("nth", F.row_number().over(W.partitionBy("item_id", "merger").orderBy(*order))).where(F.col("nth") <= k)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked_search(docs, items)


SQL = r"""
WITH dw AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dw GROUP BY doc_id, term),
n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
m AS (SELECT doc_id, CAST(10 + (90 * CAST(n AS BIGINT) * docs) // terms AS BIGINT) AS m FROM n, total),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
