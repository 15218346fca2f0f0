"""Quality events: what is wrong with actions and identities, how bad it is, and whether it blocks signals; their listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT = ["event_id", "instrument", "trade_date", "event_type", "cause", "severity", "blocks", "note"]


def named(rows: DataFrame, event_type: str, cause: Column, critical: Column, blocks: Column, note: Column, *parts: str) -> DataFrame:
    """Rows as EVENT; the id is a hash of type, cause and the parts that make an event the same from day to day."""
    key = F.concat_ws("|", F.lit(event_type), cause, *[F.coalesce(F.col(p).cast("string"), F.lit("unknown")) for p in parts])
    return rows.select(
        F.concat(F.lit("dq-"), F.substring(F.sha2(key.cast("binary"), 256), 1, 20)).alias("event_id"), "instrument", "trade_date", F.lit(event_type).alias("event_type"), cause.alias("cause"),
        F.when(critical, "CRITICAL").otherwise("WARNING").alias("severity"), blocks.alias("blocks"), note.alias("note"),
    )


def action_events(factors: DataFrame, conflict_blocks: bool = True) -> DataFrame:
    """EVENT rows of day_factors(instrument, ex_date, kind, num, den, raw, state, and status of the reading).

    An action has one cause at most: RATIO_UNKNOWN and FACTOR_UNKNOWN where a factor can't be derived, RATIO_UNCONFIRMED where prices don't
    show it (one an ex-date, none if any reading of the date was entered by hand), CONFLICT where sources disagree. All but a
    conflict block; a conflict does if conflict_blocks and the action scales prices, else it is a warning. A date with an UNMODELLED reading has a
    warning for that and no other event, as both are the same record.
    """
    day = W.partitionBy("instrument", "ex_date")
    scaling = F.col("kind").isin("SPLIT", "BONUS")
    flag = lambda test: F.max(F.coalesce(test, F.lit(False)).cast("int")).over(day) == 1
    rows = factors.withColumns({"odd": flag(F.col("kind") == "UNMODELLED"), "by_hand": flag(F.col("status") == "MANUAL_OVERRIDE"), "trade_date": F.col("ex_date")})
    cause = (
        F.when(F.col("kind") == "UNMODELLED", "UNMODELLED").when(F.col("odd"), None).when((F.col("state") == "UNKNOWN") & scaling, "RATIO_UNKNOWN").when(F.col("state") == "UNKNOWN", "FACTOR_UNKNOWN")
        .when((F.col("state") == "UNCONFIRMED") & ~F.col("by_hand"), "RATIO_UNCONFIRMED").when(F.col("status") == "PROVIDER_CONFLICT", "CONFLICT")
    )
    rows = rows.withColumn("cause", cause).where("cause IS NOT NULL")
    nth = F.row_number().over(W.partitionBy("instrument", "ex_date", "cause").orderBy("kind", "num", "den"))
    rows = rows.withColumn("nth", nth).where((F.col("cause") != "RATIO_UNCONFIRMED") | (F.col("nth") == 1))
    conflict = F.col("cause") == "CONFLICT"
    critical = (F.col("cause") != "UNMODELLED") & (~conflict | scaling)
    blocks = critical & (~conflict | F.lit(conflict_blocks))
    return named(rows, "CORPORATE_ACTION_UNRESOLVED", F.col("cause"), critical, blocks, F.col("kind"), "instrument", "kind", "ex_date").select(*EVENT)


def identity_events(codes: DataFrame, splits: DataFrame, days_before: int = 7, days_after: int = 1) -> DataFrame:
    """EVENT rows of code changes without a split nearby; codes(instrument, trade_date, code), splits(instrument, ex_date).

    A change is a bar whose code isn't that of the bar before. It is explained by a split whose ex-date is up to days_before before it, or up to
    days_after behind. Null codes are passed over.
    """
    w = W.partitionBy("instrument").orderBy("trade_date")
    before = F.lag("code").over(w)
    changes = codes.where("code IS NOT NULL").withColumn("before", before).where(F.col("before") != F.col("code"))
    marks = splits.select("instrument", F.col("ex_date").alias("trade_date"), F.col("ex_date")).distinct()
    rows = changes.select("instrument", "trade_date", "code", "before", F.lit(None).cast("date").alias("ex_date")).unionByName(marks, allowMissingColumns=True)
    order = W.partitionBy("instrument").orderBy("trade_date")
    rows = rows.withColumns({"past": F.max("ex_date").over(order.rangeBetween(W.unboundedPreceding, 0)), "coming": F.min("ex_date").over(order.rangeBetween(0, W.unboundedFollowing))}).where("code IS NOT NULL")
    near = F.coalesce(F.datediff("trade_date", "past") <= days_before, F.lit(False)) | F.coalesce(F.datediff("coming", "trade_date") <= days_after, F.lit(False))
    rows = rows.where(~near)
    return named(rows, "IDENTITY_CHANGE", F.lit("CODE_CHANGED"), F.lit(False), F.lit(False), F.concat_ws(" to ", "before", "code"), "instrument", "trade_date", "code").select(*EVENT)


def event_counts(events: DataFrame) -> DataFrame:
    """(event_type, cause, severity, n, blocking) of events."""
    return events.groupBy("event_type", "cause", "severity").agg(F.count("*").alias("n"), F.count_if("blocks").alias("blocking"))


def event_page(events: DataFrame, limit: int, severity: str | None = None, event_type: str | None = None, instrument: int | None = None) -> DataFrame:
    """The newest events that match, days without a date last, then by id; filters ignore case. total is how many match before the limit."""
    rows = events
    for column, wanted in (("severity", severity), ("event_type", event_type)):
        rows = rows if wanted is None else rows.where(F.upper(column) == wanted.upper())
    rows = rows if instrument is None else rows.where(F.col("instrument") == instrument)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc_nulls_last("trade_date"), "event_id").limit(limit).crossJoin(F.broadcast(total))
