"""Line dedup: repeated lines of a corpus go, all but those in one document, by keep bitmaps instead of moved text.

Hashes of line keys are range-partitioned by key and document, so that a key which a third of all documents hold is spread
over neighbouring partitions, and sorted by key, document and position. A window over that order, which needs no further
shuffle, streams the rows and marks the first occurrence of each key in each document; only these are counted, by
partial aggregates, and only a key's count and document meet. What comes back per document is a run-length compressed
bitmap of dropped lines; text joins it once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.shared import BLANKS, hash128, lower_az, partitions_for, stored


def line_occurrences(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc_id, text_key, pos) of each line whose key has min_chars code points or more; pos counts from 0."""
    line = F.btrim(F.col("line"), F.lit(BLANKS))
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), F.split(lower_az(F.col("text")), "\n", -1).alias("lines"))
    lines = rows.select("doc_id", "text_key", F.posexplode("lines").alias("pos", "line"))
    h1, h2 = hash128(line)
    return lines.where(F.char_length(line) >= min_chars).select(h1.alias("h1"), h2.alias("h2"), "doc_id", "text_key", "pos")


def first_occurrences(found: DataFrame) -> DataFrame:
    """(h1, h2, doc_id): the first occurrence of each key in each document, streamed off rows sorted by key, document and position.

    The range partitions keep a key's rows of one document together, so the window sorts them where they are.
    """
    ranged = found.select("h1", "h2", "doc_id", "pos").repartitionByRange(partitions_for(found, 28), "h1", "h2", "doc_id")
    nth = F.row_number().over(W.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    return ranged.withColumn("nth", nth).where("nth = 1").select("h1", "h2", "doc_id")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_key, n_dropped, drop_starts, drop_ends): run-length bitmaps of texts that lose lines.

    A run covers lines drop_starts[i] to drop_ends[i], both included; all other lines stay. Texts that lose nothing have no
    row. Rows that share a doc_id are one document where documents are counted, and each of their texts has a bitmap of its
    own; rows without a doc_id lose nothing.
    """
    found = stored(line_occurrences(docs, min_chars), "line-occurrences")
    seen = first_occurrences(found).groupBy("h1", "h2").agg(F.max("doc_id").alias("keep_in"), F.count("*").alias("n_docs"))
    firsts = seen.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keep_in")
    lost = found.join(stored(firsts, "line-firsts"), ["h1", "h2"]).where(F.col("doc_id") != F.col("keep_in"))
    per_doc = lost.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    last = F.size("p") - 1
    starts = F.filter("p", lambda x, i: (i == 0) | (x - F.element_at("p", F.greatest(i, F.lit(1))) != 1))
    ends = F.filter("p", lambda x, i: (i == last) | (F.element_at("p", F.least(i + 2, last + 1)) - x != 1))
    return per_doc.select("doc_id", "text_key", F.size("p").cast("long").alias("n_dropped"), starts.alias("drop_starts"), ends.alias("drop_ends"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text, drop_starts, drop_ends.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of min_chars code points or more that
    min_docs documents or more hold lose their lines everywhere but in the largest doc_id. A null or empty text is
    one empty line. Rows without doc_id come back whole; of rows that share one, each loses its own lines. Other columns of docs are neither read nor returned.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = keep_bitmaps(docs, min_chars, min_docs)
    lines = F.split(F.col("text"), "\n", -1)
    before = F.concat(F.array(F.lit(-1)), F.slice("drop_ends", 1, F.greatest(F.size("drop_ends") - 1, F.lit(0))))
    runs = F.transform(
        F.arrays_zip("drop_starts", "drop_ends", before.alias("b")),
        lambda r: F.concat(F.array_repeat(F.lit(True), r["drop_starts"] - r["b"] - 1), F.array_repeat(F.lit(False), r["drop_ends"] - r["drop_starts"] + 1)),
    )
    rest = F.array_repeat(F.lit(True), F.size(lines) - 1 - F.element_at("drop_ends", -1))
    keep = F.flatten(F.concat(runs, F.array(rest)))
    marked = F.filter(F.arrays_zip(lines.alias("line"), keep.alias("keep")), lambda x: x["keep"])
    kept = F.when(F.col("n_dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(marked, lambda x: x["line"]), "\n"))
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), text.alias("text")).join(bits, ["doc_id", "text_key"], "left").select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        kept.alias("kept_text"), "drop_starts", "drop_ends",
    )


def op1(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keep_in FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> g.keep_in, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
