"""Exact dedup by content-defined chunk recipes.

Each text is cut where its own content says so, every distinct chunk gets one verified identifier, and documents
are compared as ordered lists of identifiers. Only chunk hashes and recipes are moved, never the long texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import lower_az, stored


def cut(least: int, most: int) -> str:
    """Chunks of least to most code points that end behind the first blank after a letter of a small class, or at the end."""
    return rf"(?s)(?:.{{{least},{most}}}?[aeioun][ \n])|(?:.{{1,{most + 2}}})"


def chunks(docs: DataFrame, least: int = 500, most: int = 4000) -> DataFrame:
    """(doc_id, text_sha256, pos, fp, p1, p2): the chunks of each normalised text, by fingerprint and proof.

    fp is a 64-bit hash; p1 and p2 hold 128 bits of the chunk's SHA-256. An empty text is one empty chunk.
    """
    norm = lower_az(F.coalesce(F.col("text"), F.lit("")))
    parts = F.regexp_extract_all("norm", F.lit(cut(least, most)), F.lit(0))
    parts = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(parts)
    rows = docs.select("doc_id", norm.alias("norm")).select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.posexplode(parts).alias("pos", "part"))
    proof = F.sha2(F.col("part").cast("binary"), 256)
    half = lambda i: F.conv(F.substring("proof", i, 16), 16, -10).cast("long")
    return rows.select("doc_id", "text_sha256", "pos", F.xxhash64("part").alias("fp"), proof.alias("proof")).select(
        "doc_id", "text_sha256", "pos", "fp", half(1).alias("p1"), half(17).alias("p2")
    )


def chunk_store(parts: DataFrame) -> DataFrame:
    """(fp, n_refs, verified): each fingerprint once; verified where all its chunks have the same proof."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("p1", "p2") for n, f in (("lo", F.min), ("hi", F.max))]
    one = (F.col("lo_p1") == F.col("hi_p1")) & (F.col("lo_p2") == F.col("hi_p2"))
    return parts.groupBy("fp").agg(F.count("*").alias("n_refs"), *ends).select("fp", "n_refs", one.alias("verified"))


def recipes(docs: DataFrame, least: int = 500, most: int = 4000) -> DataFrame:
    """(doc_id, text_sha256, n_rows, recipe): the ordered chunk identifiers of each distinct (doc_id, text).

    An identifier is the fingerprint where the store has verified it, and the proof beside it where two chunks share it.
    """
    parts = stored(chunks(docs, least, most), "chunks")
    named = parts.join(stored(chunk_store(parts), "chunk-store"), "fp")
    proof = [F.when(~F.col("verified"), F.col(c)).alias(c) for c in ("p1", "p2")]
    named = named.select("doc_id", "text_sha256", "pos", F.struct("fp", *proof).alias("id"))
    lists = named.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("pos", "id"))).alias("r"), F.count(F.when(F.col("pos") == 0, 1)).alias("n_rows"))
    return lists.select("doc_id", "text_sha256", "n_rows", F.transform("r", lambda x: x["id"]).alias("recipe"))


def exact_dedup(docs: DataFrame, least: int = 500, most: int = 4000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest doc_id stays; a null doc_id is smaller than any. Of repeated rows with that doc_id and text one stays. Other
    columns are neither read nor returned. An empty table gives an empty result.
    """
    lists = stored(recipes(docs, least, most), "recipes")
    groups = stored(lists.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size")), "recipe-groups")
    out = lists.join(groups, "recipe").select("doc_id", "keep_id", "group_size", "text_sha256", F.size("recipe").cast("long").alias("n_chunks"), F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_chunks")


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay; of repeated rows one."""
    def key(doc_id, sha):
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), sha)

    norm = lower_az(F.coalesce(docs["text"], F.lit("")))
    kept = exact_dedup(docs).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    rows = docs.withColumn("_key", key(docs["doc_id"], F.sha2(norm.cast("binary"), 256)))
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def op9(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
