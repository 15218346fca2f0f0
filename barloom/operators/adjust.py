"""Corporate actions: factors, adjusted prices, unexplained gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import asof
from barloom.operators.features import by_day


def unadjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """What traded: prices divided by the factors of all later actions (the inverse of adjust)."""
    factor = F.coalesce(F.col("cumulative"), F.lit(1.0))
    return asof.forward(bars, cumulative(actions), ["instrument"], "trade_date", "ex_date", ["cumulative"]).select(*[F.col(c) if c not in ("open", "high", "low", "close") else (F.col(c) / factor).alias(c) for c in bars.columns])


def cumulative(actions: DataFrame) -> DataFrame:
    """(instrument, ex_date, cumulative): the product of factors from the newest ex-date back to this one, one row per date.

    Actions of one date multiply; a factor of 1 has no effect and no row.
    """
    per_day = actions.groupBy("instrument", "ex_date").agg(F.exp(F.sum(F.log("factor"))).alias("factor")).where(F.abs(F.col("factor") - 1) > 1e-12)
    w = W.partitionBy("instrument").orderBy(F.desc("ex_date")).rowsBetween(W.unboundedPreceding, 0)
    return per_day.select("instrument", "ex_date", F.exp(F.sum(F.log("factor")).over(w)).alias("cumulative"))


def replace_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(instrument, ex_date, num, den, state): an instrument's factors are replaced as a set, and only if the set's key changed.

    The key is a hash of the ordered ratios. An unchanged set is KEPT as it is; of a changed one all old rows are CLOSED and all
    new ones OPENED. An instrument without new rows loses its set. Repeated rows count once.
    """
    text = F.concat_ws(":", "ex_date", "num", "den")
    keyed = lambda rows, name: rows.groupBy("instrument").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(text))), 256).alias(name))
    changed = keyed(old, "a").join(keyed(new, "b"), "instrument", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("instrument", F.lit(True).alias("changed"))
    cols = ["instrument", "ex_date", "num", "den"]
    was = old.select(*cols).distinct().join(changed, "instrument", "left").select(*cols, F.when(F.col("changed"), "CLOSED").otherwise("KEPT").alias("state"))
    return was.unionByName(new.select(*cols).distinct().join(changed, "instrument").select(*cols, F.lit("OPENED").alias("state")))


def adjust(raw: DataFrame, actions: DataFrame) -> DataFrame:
    """Adjusted bars: prices times the cumulative factor of the first ex-date after the bar, volume divided by it; null volume stays null."""
    found = asof.forward(raw, cumulative(actions), ["instrument"], "trade_date", "ex_date", ["cumulative"])
    k = F.coalesce(F.col("cumulative"), F.lit(1.0))
    return found.select("instrument", "trade_date", *[(F.col(c) * k).alias(c) for c in ("open", "high", "low", "close")], (F.col("volume") / k).alias("volume"), k.alias("factor"))


#: Small ratios that a gap may hint at, as (numerator, denominator).
RATIOS = ((1, 2), (2, 3), (1, 3), (3, 4), (1, 4), (1, 5), (1, 10))


def gaps(raw: DataFrame, actions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Opens that jump by the threshold or more against the close before, and what is left once actions in between are undone.

    blocks: a jump down that actions don't explain. hint: the nearest small ratio.
    """
    w = by_day()
    rows = raw.select("instrument", "trade_date", "open", F.lag("close").over(w).alias("prev_close"), F.lag("trade_date").over(w).alias("prev_date")).where("prev_close > 0")
    rows = rows.withColumn("jump", F.col("open") / F.col("prev_close")).where(F.abs(F.col("jump") - 1) >= threshold)
    a = actions.select("instrument", "ex_date", "factor")
    inside = rows.join(a, "instrument", "left").where(F.col("ex_date").isNull() | ((F.col("ex_date") > F.col("prev_date")) & (F.col("ex_date") <= F.col("trade_date"))))
    undone = inside.groupBy("instrument", "trade_date").agg(F.exp(F.sum(F.log("factor"))).alias("explained"))
    out = rows.join(undone, ["instrument", "trade_date"], "left").withColumn("residual", F.col("jump") / F.coalesce("explained", F.lit(1.0)))
    near = F.array(*[F.struct(F.abs(F.col("jump") - F.lit(n / d)).alias("off"), F.lit(f"{n}:{d}").alias("ratio")) for n, d in RATIOS])
    return out.select("instrument", "trade_date", "jump", "residual", (F.col("residual") <= 1 - threshold).alias("blocks"), F.array_min(near)["ratio"].alias("hint"))


#: A ratio so far from 1 must show in the prices; the smallest demerger factor; a rise over the close before that is none.
VISIBLE_GAP, LEAST_DEMERGER, NO_CHANGE = 0.30, 0.02, 0.01


def ex_prices(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """actions(instrument, ex_date, ...) with prior_close, ex_open and raw: the close of the last bar before the ex-date and the open on it.

    raw: both bars are of the exchange itself (provider 'EXCHANGE'), or the one before where the instrument did not trade. All are null
    where no bar comes before.
    """
    before = asof.backward(actions, bars.select("instrument", "trade_date", F.struct("close", "provider").alias("b")), ["instrument"], "ex_date", "trade_date", ["b"], strict=True)
    on = bars.select("instrument", F.col("trade_date").alias("ex_date"), F.struct("open", "provider").alias("o"))
    rows = before.join(on, ["instrument", "ex_date"], "left")
    raw = (F.col("b.provider") == "EXCHANGE") & (F.col("o").isNull() | (F.col("o.provider") == "EXCHANGE"))
    there = F.col("b").isNotNull()
    return rows.select(*actions.columns, F.col("b.close").alias("prior_close"), F.when(there, F.col("o.open")).alias("ex_open"), F.when(there, raw).alias("raw"))


def day_factors(priced: DataFrame) -> DataFrame:
    """priced(ex_prices() of instrument, ex_date, kind, num, den, price) with state, price_factor and volume_factor.

    Two phases an ex-date. SPLIT and BONUS have the factor den / num and den / (num + den). It is WITHHELD where the date also has an UNMODELLED
    reading (SUPERSEDED), and where raw prices don't show it though it is large enough to be seen (UNCONFIRMED). The factors that are left put the close
    before on the scale after them; on that close stand RIGHTS (theoretical price after them, 1 without discount) and
    DEMERGER (the open over that close; 1 up to NO_CHANGE above it, none below LEAST_DEMERGER; num / den where given by hand).
    A factor that can't be derived from raw prices is UNKNOWN; from others nothing is derived (NOT_RAW).
    """
    day = W.partitionBy("instrument", "ex_date")
    scaling = F.col("kind").isin("SPLIT", "BONUS")
    usable = F.coalesce((F.col("num") > 0) & (F.col("den") > 0), F.lit(False))
    ratio = F.when(usable & (F.col("kind") == "SPLIT"), F.col("den") / F.col("num")).when(usable & (F.col("kind") == "BONUS"), F.col("den") / (F.col("num") + F.col("den")))
    rows = priced.withColumn("ratio", ratio).withColumn("odd", F.max((F.col("kind") == "UNMODELLED").cast("int")).over(day) == 1)
    large = (F.col("ratio") <= 1 - VISIBLE_GAP) | (F.col("ratio") >= 1 / (1 - VISIBLE_GAP))
    shown = F.abs(F.col("ex_open") / (F.col("prior_close") * F.col("ratio")) - 1) < VISIBLE_GAP
    hidden = F.coalesce(F.col("raw") & (F.col("prior_close") > 0) & (F.col("ex_open") > 0) & large & ~shown, F.lit(False))
    first = F.when(~scaling, None).when(F.col("odd"), "SUPERSEDED").when(F.col("ratio").isNull(), "UNKNOWN").when(hidden, "UNCONFIRMED").otherwise("APPLIED")
    rows = rows.withColumn("first", first).withColumn("scale", F.exp(F.coalesce(F.sum(F.when(F.col("first") == "APPLIED", F.log("ratio"))).over(day), F.lit(0.0))))
    p, a, b, o = F.col("prior_close") * F.col("scale"), F.col("num"), F.col("den"), F.col("ex_open")
    terp = F.when(usable & (F.col("price") >= 0) & (p > 0), F.when(F.col("price") >= p, 1.0).otherwise((b * p + a * F.col("price")) / ((a + b) * p)))
    by_hand = F.when(usable, F.when(a / b <= 1, a / b))
    opened = F.when((p > 0) & (o > 0), F.when(o >= p, F.when(o <= p * (1 + NO_CHANGE), 1.0)).otherwise(F.when(o / p >= LEAST_DEMERGER, o / p)))
    second = F.when(F.col("kind") == "RIGHTS", terp).when(F.col("kind") == "DEMERGER", F.when(usable, by_hand).otherwise(opened))
    rows = rows.withColumn("second", second)
    hand = (F.col("kind") == "DEMERGER") & usable
    state = F.when(scaling, F.col("first")).when(F.col("kind") == "UNMODELLED", "UNMODELLED").when(~hand & ~F.coalesce("raw", F.lit(False)), "NOT_RAW").when(F.col("second").isNull(), "UNKNOWN").otherwise("APPLIED")
    factor = F.when(F.col("state") == "APPLIED", F.coalesce("ratio", "second"))
    volume = F.when(F.col("kind") == "DEMERGER", F.when(factor.isNotNull(), 1.0)).otherwise(1 / factor)
    return rows.withColumn("state", state).select(*priced.columns, "state", factor.alias("price_factor"), volume.alias("volume_factor"))


def provider_verdict(priced: DataFrame, least_log: float = 0.18232155679395463) -> DataFrame:
    """(instrument, ex_date, factor, observed, verdict) of actions(instrument, ex_date, factor, prior_close, next_open): whether a provider's bars already contain an action.

    ADJUSTED where the move over the ex-date is within a quarter of the expected jump of none at all, RAW where it is of the jump, each the nearer of
    the two by logs; else INCONCLUSIVE, as for factors within a fifth of 1 and for missing prices.
    """
    jump, move = F.log("factor"), F.log(F.col("next_open") / F.col("prior_close"))
    usable = (F.col("factor") > 0) & (F.abs(jump) >= least_log) & (F.col("prior_close") > 0) & (F.col("next_open") > 0)
    off, raw_off, margin = F.abs(move), F.abs(move - jump), F.abs(jump) / 4
    verdict = F.when(usable & (off < margin) & (off < raw_off), "ADJUSTED").when(usable & (raw_off < margin) & (raw_off < off), "RAW").otherwise("INCONCLUSIVE")
    return priced.select("instrument", "ex_date", "factor", (F.col("next_open") / F.when(F.col("prior_close") > 0, F.col("prior_close"))).alias("observed"), verdict.alias("verdict"))
