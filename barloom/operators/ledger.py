"""A ledger of paper trades: the events that frozen rules give, what of them may be appended, and where things stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import asof
from barloom.operators.features import by_day

EVENT = "rule string, instrument long, event_date date, event_type string, scan_date date, price double, ret_pct double, note string"
#: Types in the order of a day. Fixed values.
TYPES = ("WATCH", "WATCH_EXPIRED", "ENTRY", "SKIPPED_NO_SLOT", "EXIT", "DAY_CLOSED")
KEY = ["rule", "instrument", "event_date", "event_type", "scan_date"]


def event(kind: str, rows: DataFrame, day: str, price=None, ret=None, note=None, scan: str | None = "signal_date") -> DataFrame:
    some = lambda c, t: F.lit(None).cast(t) if c is None else F.col(c).cast(t)
    return rows.select("rule", some("instrument" if "instrument" in rows.columns else None, "long").alias("instrument"), F.col(day).alias("event_date"), F.lit(kind).alias("event_type"), some(scan, "date").alias("scan_date"), some(price, "double").alias("price"), some(ret, "double").alias("ret_pct"), some(note, "string").alias("note"))


def watches(signals: DataFrame, trades: DataFrame, bars: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, instrument, signal_date, score, ends, why): signals that were watched, of signals(instrument, trade_date, score) and rules(rule, watch).

    A signal behind an entry, up to and including the bar of its exit, is passed over. A watch without a trade ends on the bar of the next signal
    (REPLACED), or on the last of its `watch` bars (NO_BREAKOUT); ends is null where it had a trade or still goes on.
    """
    w = by_day()
    # Each length that a watch has is a day of its own; no bar carries a list of the days behind it.
    lengths = sorted(r.watch for r in rules.select("watch").distinct().collect() if r.watch is not None)
    ahead = bars.select("instrument", "trade_date", *[(F.lead("trade_date", k).over(w) if k > 0 else F.lit(None).cast("date")).alias(f"_day_{k}") for k in lengths])
    at = signals.select("instrument", "trade_date", "score").join(ahead, ["instrument", "trade_date"]).withColumnRenamed("trade_date", "signal_date").crossJoin(F.broadcast(rules))
    held = trades.select("rule", "instrument", "entry_date", F.struct("exit_date", "exit_kind").alias("x"))
    seen = asof.backward(at, held, ["rule", "instrument"], "signal_date", "entry_date", ["x"], strict=True)
    inside = F.coalesce((F.col("x.exit_date") >= F.col("signal_date")) | (F.col("x.exit_kind") == "OPEN"), F.lit(False))
    live = seen.where(~inside).join(trades.select("rule", "instrument", "signal_date", F.lit(True).alias("traded")), ["rule", "instrument", "signal_date"], "left")
    following = F.lead("signal_date").over(W.partitionBy("rule", "instrument").orderBy("signal_date"))
    last = F.coalesce(*[F.when(F.col("watch") == k, F.col(f"_day_{k}")) for k in lengths], F.lit(None).cast("date"))
    live = live.withColumn("following", following).withColumn("last", last)
    replaced = F.col("following").isNotNull() & (F.col("last").isNull() | (F.col("following") <= F.col("last")))
    ends = F.when(F.col("traded"), None).when(replaced, F.col("following")).otherwise(F.col("last"))
    why = F.when(F.col("traded"), None).when(replaced, "REPLACED").when(F.col("last").isNotNull(), "NO_BREAKOUT")
    return live.select("rule", "instrument", "signal_date", "score", ends.alias("ends"), why.alias("why"))


def ledger(watched: DataFrame, trades: DataFrame, taken: DataFrame, sessions: DataFrame, regimes: DataFrame | None = None) -> DataFrame:
    """EVENT rows: WATCH and WATCH_EXPIRED of watches(), ENTRY and EXIT of taken(rule, instrument, entry_date), SKIPPED_NO_SLOT of other trades, DAY_CLOSED of each session and rule.

    note is the score of a watch, the reason of its end, the kind of an exit, and whether the regime was on; regimes(trade_date, on). Trades that
    are OPEN have no exit. Repeated sessions close once.
    """
    keys = ["rule", "instrument", "entry_date"]
    done = trades.join(taken.select(*keys).distinct(), keys, "left_semi")
    lost = trades.join(taken.select(*keys), keys, "left_anti")
    days = sessions.select("trade_date").distinct()
    days = days.join(regimes.select("trade_date", F.when(F.col("on"), "regime on").otherwise("regime off").alias("note")), "trade_date", "left") if regimes is not None else days.withColumn("note", F.lit(None).cast("string"))
    closed = days.crossJoin(F.broadcast(trades.select("rule").distinct()))
    parts = [
        event("WATCH", watched.withColumn("note", F.col("score").cast("string")), "signal_date", note="note"), event("WATCH_EXPIRED", watched.where("ends IS NOT NULL"), "ends", note="why"), event("ENTRY", done, "entry_date", price="entry"),
        event("SKIPPED_NO_SLOT", lost, "entry_date", price="entry"), event("EXIT", done.where("exit_kind <> 'OPEN'"), "exit_date", price="exit", ret="ret_pct", note="exit_kind"), event("DAY_CLOSED", closed, "trade_date", note="note", scan=None),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plan_update(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """What a ledger may take from derived events: EVENT rows with state NEW, STORED_ONLY or DERIVED_ONLY.

    Days up to a rule's last stored DAY_CLOSED are closed: nothing of them is appended, and where derived events differ from the stored ones by
    key and price (four decimals) both sides are named. NEW are the events behind that day, all of a rule that has no closed day. Stored events of
    other types than TYPES, such as divergences noted before, are no part of the comparison.
    """
    last = stored.where("event_type = 'DAY_CLOSED'").groupBy("rule").agg(F.max("event_date").alias("last"))
    ours, theirs = (rows.where(F.col("event_type").isin(*TYPES)).join(last, "rule", "left") for rows in (derived, stored))
    is_new = F.col("last").isNull() | (F.col("event_date") > F.col("last"))
    says = [*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(f"_{c}") for c in KEY], F.coalesce(F.round("price", 4).cast("string"), F.lit("-")).alias("_price")]
    keyed = lambda rows: rows.select("*", F.concat_ws("|", *says).alias("says"))
    old, was = keyed(ours.where(~is_new)), keyed(theirs.where(F.col("last").isNotNull()))
    only = lambda a, b, state: a.join(b.select("says").distinct(), "says", "left_anti").withColumn("state", F.lit(state))
    rows = [keyed(ours.where(is_new)).withColumn("state", F.lit("NEW")), only(was, old, "STORED_ONLY"), only(old, was, "DERIVED_ONLY")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).drop("says", "last")


def append_update(update: DataFrame, path: str) -> None:
    """Appends the NEW events of plan_update() to a ledger on disk. Closed days are never written; differences stay with the caller."""
    update.where("state = 'NEW'").drop("state").write.mode("append").parquet(path)


def status(events: DataFrame) -> DataFrame:
    """One row a rule: through, closed, win_rate, avg_ret, profit_factor, n_open, skipped. A position is open if its entry has no exit of the same instrument and scan."""
    exits = events.where("event_type = 'EXIT'")
    held = events.where("event_type = 'ENTRY'").join(exits.select("rule", "instrument", "scan_date").distinct(), ["rule", "instrument", "scan_date"], "left_anti").groupBy("rule").agg(F.count("*").alias("n_open"))
    r = F.when(F.col("event_type") == "EXIT", F.col("ret_pct"))
    losses = -F.sum(F.when(r < 0, r))
    rows = events.groupBy("rule").agg(
        F.max(F.when(F.col("event_type") == "DAY_CLOSED", F.col("event_date"))).alias("through"), F.count(r).alias("closed"), F.coalesce(F.avg(F.when(r > 0, 100.0).when(r.isNotNull(), 0.0)), F.lit(0.0)).alias("win_rate"), F.coalesce(F.avg(r), F.lit(0.0)).alias("avg_ret"),
        F.when(losses > 0, F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)) / losses).alias("profit_factor"), F.count_if(F.col("event_type") == "SKIPPED_NO_SLOT").alias("skipped"),
    )
    return rows.join(held, "rule", "left").select("rule", "through", "closed", "win_rate", "avg_ret", "profit_factor", F.coalesce("n_open", F.lit(0)).alias("n_open"), "skipped")
