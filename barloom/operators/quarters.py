"""Quarters of a stock as known at a day: the basis chosen, earnings on one share basis, growth and margins, and a screener over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import ratio
from barloom.operators import asof


def known_at(snapshots: DataFrame, cutoff: str) -> DataFrame:
    """The highest revision of each (entity, period_end, basis) that was available by the cutoff and is not INVALID."""
    rows = snapshots.where((F.col("available_at") <= F.lit(cutoff).cast("date")) & ~F.col("status").eqNullSafe(F.lit("INVALID")))
    nth = F.row_number().over(W.partitionBy("entity", "period_end", "basis").orderBy(F.desc("revision")))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")


def share_scale(rows: DataFrame, actions: DataFrame, on: str, name: str) -> DataFrame:
    """rows with the log of all factors of actions(entity, ex_date, factor) up to the day `on`."""
    per_day = actions.groupBy("entity", "ex_date").agg(F.sum(F.log("factor")).alias("step"))
    upto = per_day.select("entity", "ex_date", F.sum("step").over(W.partitionBy("entity").orderBy("ex_date")).alias("upto"))
    found = asof.backward(rows, upto, ["entity"], on, "ex_date", ["upto"])
    return found.select(*rows.columns, F.coalesce("upto", F.lit(0.0)).alias(name))


def growth_of(now: Column, before: Column) -> tuple[Column, Column]:
    """(percent change, state): a base that isn't above zero has no growth."""
    state = F.when(now.isNull() | before.isNull(), "MISSING").when(before <= 0, "NEGATIVE_BASE").otherwise("AVAILABLE")
    return F.when(state == "AVAILABLE", (now / before - 1) * 100), state


def quarter_history(snapshots: DataFrame, actions: DataFrame, cutoff: str, limit: int = 12) -> DataFrame:
    """The last `limit` quarters of each entity as known at the cutoff: (entity, period_end, basis, revision, available_at, revenue, eps, eps_as_filed, operating_margin, net_margin, eps_yoy, eps_yoy_state, sales_yoy, sales_yoy_state, age).

    The basis is CONSOLIDATED where the latest quarter has one, else STANDALONE, and stays the same for all of an entity's quarters. eps is on
    the share basis of the latest quarter: factors of actions between both filings apply. A year before that only the other basis
    has is BASIS_CHANGE, one that neither has MISSING. Margins are null without revenue above zero; financial companies have no
    operating margin. age counts back from the latest quarter, which is 1. Null periods and entities are left out.
    """
    rows = known_at(snapshots.dropna(subset=["entity", "period_end"]), cutoff)
    newest = F.max("period_end").over(W.partitionBy("entity"))
    rows = rows.withColumn("whole", F.max((F.col("basis") == "CONSOLIDATED") & (F.col("period_end") == newest)).over(W.partitionBy("entity")))
    rows = rows.withColumn("wanted", F.when(F.col("whole"), "CONSOLIDATED").otherwise("STANDALONE"))
    mine, other = rows.where("basis = wanted"), rows.where("basis <> wanted")
    last = W.partitionBy("entity").orderBy(F.desc("period_end"))
    mine = mine.withColumns({"age": F.row_number().over(last), "latest_at": F.first("available_at").over(last)})
    mine = share_scale(share_scale(mine, actions, "available_at", "scale"), actions, "latest_at", "latest_scale")
    mine = mine.withColumn("eps_now", F.col("eps") * F.exp(F.col("latest_scale") - F.col("scale")))
    year_on = F.last_day(F.add_months("period_end", 12)).alias("period_end")
    then = mine.select("entity", year_on, F.col("eps_now").alias("eps_then"), F.col("revenue").alias("revenue_then"), F.lit(True).alias("has_then"))
    elsewhere = other.select("entity", year_on, F.lit(True).alias("has_other")).distinct()
    out = mine.where(F.col("age") <= limit).join(then, ["entity", "period_end"], "left").join(elsewhere, ["entity", "period_end"], "left")
    pairs = {"eps_yoy": growth_of(F.col("eps_now"), F.col("eps_then")), "sales_yoy": growth_of(F.col("revenue"), F.col("revenue_then"))}
    no_base = F.when(F.col("has_other"), "BASIS_CHANGE").otherwise("MISSING")
    sold = F.when(F.col("revenue") > 0, F.col("revenue"))
    operating = F.when(~F.coalesce("is_financial", F.lit(False)), ratio(F.col("pbt") + F.col("finance_costs") + F.col("depreciation") - F.col("other_income"), sold) * 100)
    return out.select(
        "entity", "period_end", "basis", "revision", "available_at", "revenue", F.col("eps_now").alias("eps"), F.col("eps").alias("eps_as_filed"), operating.alias("operating_margin"), (ratio(F.col("net_profit"), sold) * 100).alias("net_margin"),
        *[c for n, (value, state) in pairs.items() for c in (value.alias(n), F.when(F.col("has_then"), state).otherwise(no_base).alias(f"{n}_state"))], "age",
    )


def current_views(history: DataFrame, cutoff: str, stale_days: int = 120) -> DataFrame:
    """One row an entity out of quarter_history(): its latest quarter, whether growth of earnings is faster than a quarter ago, and whether it is stale."""
    w = W.partitionBy("entity").orderBy("period_end")
    faster = F.when(F.lag("age").over(w) == F.col("age") + 1, F.col("eps_yoy") - F.lag("eps_yoy").over(w))
    stale = F.datediff(F.lit(cutoff).cast("date"), "available_at") > stale_days
    return history.withColumn("eps_acceleration", faster).where("age = 1").withColumn("stale", stale).drop("age")


def screened_views(views: DataFrame, min_eps_yoy: float | None = None, min_sales_yoy: float | None = None, min_margin: float | None = None, accelerating: bool = False, current_only: bool = False) -> DataFrame:
    """Views that pass every filter that is set; a missing value passes no floor."""
    for column, floor in (("eps_yoy", min_eps_yoy), ("sales_yoy", min_sales_yoy), ("operating_margin", min_margin)):
        views = views if floor is None else views.where(F.col(column) >= floor)
    views = views.where(F.col("eps_acceleration") > 0) if accelerating else views
    return views.where(~F.col("stale")) if current_only else views
