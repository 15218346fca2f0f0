"""What the text operators share: tables in the cluster's shared folder, folds, bounded label samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: `[\x20\x09-\x0D]` as a set of characters.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master one of our own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/barloom"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(table: DataFrame, row_bytes: int, part_bytes: int = 64_000_000) -> int:
    """How many partitions a shuffle of a written table wants: as configured, or more where a part would grow beyond part_bytes."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, -(-table.count() * row_bytes // part_bytes))


def lower_az(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does just that on ASCII text, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash128(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes under different seeds: one key of 128 bits."""
    return F.xxhash64(c), F.xxhash64(F.lit("barloom"), c)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from; a null id is in no fold and counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *more: str) -> DataFrame:
    """(doc_id, text, *more, y): at most per_class rows of each class of a label, of the training fold.

    The choice goes by a hash of doc_id, so it doesn't depend on order or partitioning. Null labels and ids,
    and labels other than 0 and 1, are left out; of repeated label rows one counts; 2 * per_class short rows are
    the whole of what is broadcast.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.where(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = [tuple(r) for part in picked for r in part.collect()]
    chosen = spark.createDataFrame(rows, known.schema)
    return docs.select("doc_id", "text", *more).join(F.broadcast(chosen), "doc_id")
