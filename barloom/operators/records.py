"""Records over time: validity out of daily lists, and runs whose results are kept as digests that a rebuild is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def validity(lists: DataFrame, fetched: DataFrame, key: str = "instrument", what: str = "flag") -> DataFrame:
    """(key, what, valid_from, valid_to, n_lists): how long each entry of daily lists(day, key, what) held.

    fetched(day) says on which days a list was fetched at all; on any other day nothing is known and what held goes on to hold. An entry
    holds from the first list that has it to the first fetched list that lacks it, that day excluded; valid_to is null while it stands.
    Rows of days that were not fetched, and rows with a null key, are left out; repeated rows count once. The days are numbered in
    one small window, a row each.
    """
    w = W.orderBy("day")
    days = fetched.select("day").where("day IS NOT NULL").distinct().select("day", F.row_number().over(w).alias("k"), F.lead("day").over(w).alias("following"))
    rows = lists.where(F.col(key).isNotNull()).select("day", key, what).distinct().join(days, "day")
    run = F.col("k") - F.row_number().over(W.partitionBy(key, what).orderBy("k"))
    spans = rows.withColumn("run", run).groupBy(key, what, "run").agg(F.min("day").alias("valid_from"), F.max_by("following", "k").alias("valid_to"), F.count("*").alias("n_lists"))
    return spans.drop("run")


def row_hash(columns: list[str]) -> Column:
    """48 bits of a hash over columns as text, nulls marked, as a number."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def digests(rows: DataFrame, by: str) -> DataFrame:
    """(by, n_rows, digest): what a result says for each value of `by`, whatever the order of its rows: sums of row hashes and of their squares' remainders.

    Sums are merged by partial aggregates, so nothing is sorted or gathered. Doubles should be rounded before.
    """
    h = row_hash(sorted(c for c in rows.columns if c != by))
    second = F.pmod(h * F.pmod(h, F.lit(8191)), F.lit(2_147_483_647))
    return rows.select(by, h.alias("h"), second.alias("g")).groupBy(by).agg(F.count("*").alias("n_rows"), F.concat_ws("-", F.sum(F.col("h").cast("decimal(38,0)")).cast("string"), F.sum("g").cast("string")).alias("digest"))


def run_records(rows: DataFrame, by: str, version: str, inputs: DataFrame) -> DataFrame:
    """(by, run_id, version, inputs_digest, n_rows, results_digest) to be kept beside rows; inputs are what the run read, with the same `by`.

    run_id names version, scope and inputs: the same run has the same name, and a record never changes.
    """
    read = digests(inputs, by).select(by, F.col("digest").alias("inputs_digest"))
    out = digests(rows, by).withColumnRenamed("digest", "results_digest").join(read, by, "left").withColumn("version", F.lit(version))
    name = F.concat_ws("|", "version", F.col(by).cast("string"), F.coalesce("inputs_digest", F.lit("none")))
    return out.select(by, F.concat(F.lit("run-"), F.substring(F.sha2(name.cast("binary"), 256), 1, 20)).alias("run_id"), "version", "inputs_digest", "n_rows", "results_digest")


def verify_runs(records: DataFrame, stored: DataFrame, rebuilt: DataFrame, by: str) -> DataFrame:
    """(by, run_id, state, n_missing, n_extra): MATCH by the digest alone; else DIFFERS with the rows that only one side has, or NOT_REBUILT.

    Only scopes whose digests differ are compared row by row; stored(the rows kept) of all others isn't read again.
    """
    now = digests(rebuilt, by).select(by, F.col("n_rows").alias("n_now"), F.col("digest").alias("now"))
    state = F.when(F.col("now").isNull(), "NOT_REBUILT").when((F.col("now") == F.col("results_digest")) & (F.col("n_now") == F.col("n_rows")), "MATCH").otherwise("DIFFERS")
    judged = records.join(now, by, "left").select(by, "run_id", state.alias("state"))
    open_ = judged.where("state = 'DIFFERS'").select(by)
    columns = sorted(rebuilt.columns)
    # Rows of both sides as +1 and -1: what doesn't cancel is on one side alone.
    both = stored.select(*columns, F.lit(1).alias("side")).unionByName(rebuilt.select(*columns, F.lit(-1).alias("side"))).join(open_, by, "left_semi")
    over = both.groupBy(*columns).agg(F.sum("side").alias("over")).groupBy(by).agg(F.sum(F.greatest("over", F.lit(0))).alias("n_missing"), F.sum(F.greatest(-F.col("over"), F.lit(0))).alias("n_extra"))
    out = judged.join(over, by, "left")
    return out.select(by, "run_id", "state", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_missing", "n_extra")])
