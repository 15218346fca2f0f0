"""Point-in-time fundamentals on a long fact table: revisions, quarters out of year-to-date sums, growth views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import change, ratio


def usable(facts: DataFrame, cutoff: str | None = None) -> DataFrame:
    """The highest revision of each (entity, period) available by the cutoff. facts: entity, period, revision, available_at, value."""
    rows = facts if cutoff is None else facts.where(F.col("available_at") <= F.lit(cutoff).cast("date"))
    w = W.partitionBy("entity", "period").orderBy(F.desc("revision"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def quarter_of_ytd(facts: DataFrame) -> DataFrame:
    """Quarter values out of year-to-date ones: the year's first as it is, others less the quarter before; null where that one is missing."""
    w = W.partitionBy("entity", F.year("period")).orderBy("period")
    before, gap = F.lag("value").over(w), F.months_between("period", F.lag("period").over(w))
    first = F.quarter("period") == 1
    return facts.withColumn("quarter_value", F.when(first, F.col("value")).when(gap == 3, F.col("value") - before))


def growth(quarters: DataFrame) -> DataFrame:
    """Per entity and quarter: change on a year and on a quarter ago, acceleration, sum of the last four, by joins on shifted periods."""
    base = quarters.select("entity", "period", "value")
    shifted = lambda months, name: base.select("entity", F.add_months("period", months).alias("period"), F.col("value").alias(name))
    rows = base
    for months, name in ((12, "year_ago"), (3, "quarter_ago"), (6, "two_ago"), (9, "three_ago"), (15, "year_ago_prior")):
        rows = rows.join(shifted(months, name), ["entity", "period"], "left")
    yoy, before = change(F.col("value"), F.col("year_ago")), change(F.col("quarter_ago"), F.col("year_ago_prior"))
    return rows.select("entity", "period", "value", yoy.alias("yoy"), change(F.col("value"), F.col("quarter_ago")).alias("qoq"), (yoy > before).alias("accelerating"), (F.col("value") + F.col("quarter_ago") + F.col("two_ago") + F.col("three_ago")).alias("ttm"))


def holding_summary(shares: DataFrame) -> DataFrame:
    """shares(entity, period, part, pct): per entity's latest period, parts as columns with their change on one and four periods before."""
    wide = shares.groupBy("entity", "period").pivot("part", ["A", "B", "C"]).agg(F.max("pct"))
    w = W.partitionBy("entity").orderBy("period")
    for c in "ABC":
        wide = wide.withColumn(f"{c}_change", F.col(c) - F.lag(c).over(w)).withColumn(f"{c}_change_4", F.col(c) - F.lag(c, 4).over(w))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in "ABC"), F.lit(0.0))
    last = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("period")))
    return wide.withColumn("n", last).where("n = 1").drop("n").withColumn("sums_up", F.abs(total - 100) < 0.5)


def facts_of_xml(spark, path: str, row_tag: str = "filing") -> tuple[DataFrame, DataFrame]:
    """(facts, rejects) of filings in a directory of XML: one fact per item, the first present tag of an item wins.

    Facts: entity, period, item, value. A filing without entity or period, or with a value that is no number, is a reject
    with its reason. Tags of an item are tried in order.
    """
    items = {"revenue": ["revenue", "total_income"], "profit": ["profit"], "eps": ["eps", "basic_eps"]}
    tags = [t for ts in items.values() for t in ts]
    schema = "entity long, period string, " + ", ".join(f"{t} string" for t in tags)
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    period = F.try_to_date("period", "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr("try_cast(period AS date)")
    bad = F.concat_ws("; ", F.when(F.col("entity").isNull(), "no entity"), F.when(period.isNull(), "no period"), *[F.when(F.col(t).isNotNull() & F.expr(f"try_cast({t} AS double)").isNull(), F.lit(f"{t} is no number")) for t in tags])
    rows = rows.withColumn("reason", bad)
    long = F.array(*[F.struct(F.lit(i).alias("item"), F.coalesce(*[F.expr(f"try_cast({t} AS double)") for t in ts]).alias("value")) for i, ts in items.items()])
    facts = rows.where("reason = ''").select("entity", period.alias("period"), F.inline(long)).where("value IS NOT NULL")
    return facts, rows.where("reason <> ''").select("entity", "period", "reason")
