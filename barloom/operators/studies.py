"""Group studies: excess over the date's mean, robustness, confusion, top-k, stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import ratio


def summarize(rows: DataFrame, key: str, date: str, win: Column) -> DataFrame:
    """Per group and for ALL: count, win rate and win rate over that of the same dates. One aggregate with grouping sets."""
    base = F.avg(F.when(win, 1.0).otherwise(0.0)).over(W.partitionBy(date))
    rows = rows.select(F.col(key).cast("string").alias("k"), F.when(win, 1.0).otherwise(0.0).alias("win"), base.alias("base"))
    out = rows.groupingSets([["k"], []], "k").agg(F.grouping("k").alias("all_rows"), F.count("*").alias("n"), F.avg("win").alias("win_rate"), F.avg(F.col("win") - F.col("base")).alias("excess"))
    return out.select(F.when(F.col("all_rows") == 1, F.lit("ALL")).otherwise(F.col("k")).alias(key), "n", "win_rate", "excess")


def leave_one_out(rows: DataFrame, period: str, value: str) -> DataFrame:
    """Per period the mean of all others, and whether its sign is the overall one. From per-period sums, so rows are read once."""
    per = rows.groupBy(period).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = per.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    both = per.crossJoin(F.broadcast(total))
    rest = ratio(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"))
    return both.select(period, rest.alias("mean_without"), (F.signum(rest) == F.signum(F.col("ts"))).alias("same_sign"))


def confusion(rows: DataFrame, label: str, got: str) -> DataFrame:
    """(label, got, n, precision, recall) of each cell of the confusion matrix; shares are those of the diagonal's class."""
    cells = rows.groupBy(label, got).agg(F.count("*").alias("n"))
    hit = F.when(F.col(label) == F.col(got), F.col("n"))
    return cells.select(label, got, "n", ratio(hit, F.sum("n").over(W.partitionBy(got))).alias("precision"), ratio(hit, F.sum("n").over(W.partitionBy(label))).alias("recall"))


def top_mean(rows: DataFrame, by: str, value: str, k: int, tie: str) -> DataFrame:
    """Mean of the k largest values of each group."""
    first = F.row_number().over(W.partitionBy(by).orderBy(F.desc(value), tie))
    return rows.where(F.col(value).isNotNull()).withColumn("_n", first).where(F.col("_n") <= k).groupBy(by).agg(F.avg(value).alias("top_mean"), F.count("*").alias("n"))


def stratified_sample(rows: DataFrame, stratum: str, key: list[str], per_stratum: int, seed: int = 7, entity: str | None = None, per_entity: int = 1) -> DataFrame:
    """Deterministic rows of each stratum by a hash of key and seed, at most per_entity of an entity in it."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    out = rows.withColumn("_h", h)
    if entity:
        out = out.withColumn("_e", F.row_number().over(W.partitionBy(stratum, entity).orderBy("_h"))).where(F.col("_e") <= per_entity).drop("_e")
    return out.withColumn("_n", F.row_number().over(W.partitionBy(stratum).orderBy("_h"))).where(F.col("_n") <= per_stratum).drop("_h", "_n")


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of both sides and of what each has alone, as one row."""
    only = lambda x, y, n: x.exceptAll(y).agg(F.count("*").alias(n))
    return a.agg(F.count("*").alias("rows_a")).crossJoin(b.agg(F.count("*").alias("rows_b"))).crossJoin(only(a, b, "only_a")).crossJoin(only(b, a, "only_b"))


def spread(rows: DataFrame, by: str, score: str, outcome: str) -> DataFrame:
    """Per date: mean outcome of the top fifth less that of the bottom fifth by score."""
    fifth = F.ntile(5).over(W.partitionBy(by).orderBy(score, outcome))
    r = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("f", fifth)
    mean = lambda k: F.avg(F.when(F.col("f") == k, F.col(outcome)))
    return r.groupBy(by).agg(F.count("*").alias("n"), (mean(5) - mean(1)).alias("spread"))


def new_years(members: DataFrame) -> DataFrame:
    """(instrument, year) of members(instrument, year), once each, where the year before is none of the instrument's. Null keys match nothing, so they are new."""
    before = F.lag("year").over(W.partitionBy("instrument").orderBy("year"))
    rows = members.distinct().withColumn("_before", before)
    return rows.where(F.col("instrument").isNull() | F.coalesce(F.col("_before") != F.col("year") - 1, F.lit(True))).drop("_before")
