"""Two time axes: when a value holds and when it was known. Appends, reads, revisions and syncs as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def intervals(seen: DataFrame, key: list[str], known_at: str, values: list[str]) -> DataFrame:
    """Knowledge intervals of observations: an unchanged one is ignored, a changed one closes the row before and opens the next."""
    w = W.partitionBy(*key).orderBy(known_at)
    same = F.row_number().over(w) > 1
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    kept = seen.select(*key, *values, F.col(known_at).alias("known_from"), same.alias("_same")).where(~F.col("_same")).drop("_same")
    return kept.withColumn("known_to", F.lead("known_from").over(W.partitionBy(*key).orderBy("known_from")))


def current(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("known_to").isNull())


def as_known(rows: DataFrame, at: Column) -> DataFrame:
    """Rows that were known at a time: opened by then and not yet closed."""
    return rows.where((F.col("known_from") <= at) & (F.col("known_to").isNull() | (F.col("known_to") > at)))


def append(now: DataFrame, incoming: DataFrame, key: list[str], values: list[str], at: Column) -> DataFrame:
    """A batch append: current rows(key, values, known_from) and incoming(key, values) to rows with known_to and an action.

    KEPT: nothing new; IGNORED has no row; CLOSED and OPENED are the two sides of a change; NEW had no current row.
    """
    old = now.select(*key, *[F.col(v).alias(f"old_{v}") for v in values], "known_from", F.lit(True).alias("had"))
    new = incoming.select(*key, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("came"))
    both = old.join(new, key, "full")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    changed = F.col("had").isNotNull() & F.col("came").isNotNull() & ~same
    opened = F.struct(F.when(F.col("had").isNull(), "NEW").otherwise("OPENED").alias("action"), *[F.col(f"new_{v}").alias(v) for v in values], at.alias("known_from"), F.lit(None).cast("date").alias("known_to"))
    closed = F.struct(F.when(changed, "CLOSED").otherwise("KEPT").alias("action"), *[F.col(f"old_{v}").alias(v) for v in values], F.col("known_from").alias("known_from"), F.when(changed, at).alias("known_to"))
    rows = F.array_compact(F.array(F.when(F.col("had").isNotNull(), closed), F.when(F.col("had").isNull() | changed, opened)))
    return both.select(*key, F.inline(rows))


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def revisions(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """revision 0, 1, ... of each key by time of broadcast."""
    return rows.withColumn("revision", F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1)


def sync_dump(now: DataFrame, dump: DataFrame, key: str, value: str, at: Column) -> DataFrame:
    """A full dump against open rows: UNCHANGED, CLOSED (gone or re-pointed) and OPENED (new or re-pointed) rows.

    An empty dump is refused by keeping every open row as it is.
    """
    size = dump.agg(F.count("*").alias("dump_rows"))
    both = now.select(key, F.col(value).alias("old")).join(dump.select(key, F.col(value).alias("new")), key, "full").crossJoin(F.broadcast(size))
    same = F.col("old").eqNullSafe(F.col("new")) | (F.col("dump_rows") == 0)
    row = lambda action, v, start, end: F.struct(F.lit(action).alias("action"), v.alias(value), start.alias("opened"), end.alias("closed"))
    none = F.lit(None).cast("date")
    rows = F.array_compact(F.array(
        F.when(F.col("old").isNotNull() & same, row("UNCHANGED", F.col("old"), none, none)),
        F.when(F.col("old").isNotNull() & ~same, row("CLOSED", F.col("old"), none, at)),
        F.when(F.col("new").isNotNull() & ~same, row("OPENED", F.col("new"), at, none)),
    ))
    return both.select(key, F.inline(rows))


def islands(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: (key, first, last, n)."""
    w = W.partitionBy(*key).orderBy(number)
    return rows.withColumn("_g", F.col(number) - F.row_number().over(w)).groupBy(*key, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_g")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has and the other lacks, as often as it has more of them, with the side's name; each side is read once."""
    on = lambda rows, left: rows.withColumns({"_left": F.lit(left), "_right": F.lit(not left)})
    return parted(on(a, True).unionByName(on(b, False)), "_left", "_right")


def parted(rows: DataFrame, left: str, right: str) -> DataFrame:
    """symmetric_difference of the rows that two boolean columns mark, in one pass over them."""
    columns = [c for c in rows.columns if c not in (left, right)]
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    more = rows.groupBy(*columns).agg(F.sum(n(left) - n(right)).alias("_more")).where("_more <> 0")
    return more.withColumn("side", F.when(F.col("_more") > 0, "LEFT").otherwise("RIGHT")).withColumn("_more", F.explode(F.sequence(F.lit(1), F.abs("_more")))).drop("_more")


def lifecycle(known: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """Events(key, state) against what a scan detects: opened, auto-resolved or kept; a human's resolution stays."""
    found = detected.select(key, F.lit(True).alias("found"))
    state = (
        F.when(F.col("state") == "RESOLVED_BY_HUMAN", F.col("state"))
        .when(F.col("found").isNotNull(), F.lit("OPEN"))
        .otherwise(F.lit("AUTO_RESOLVED"))
    )
    both = known.join(found, key, "full")
    return both.select(key, F.col("state").alias("old_state"), state.alias("new_state"), (~F.col("state").eqNullSafe(state)).alias("changed"))
