"""Hand-worked frames: warm-up, ties, missing values, order of events, and that nothing after a date is read."""

import random
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import change, finite, ladder
from barloom.operators import adjust, asof, backtest, features, labels, market, patterns, strength, studies, temporal, trend
from barloom.operators.fundamentals import facts_of_xml

D0 = date(2020, 1, 1)


def bars(spark, closes, instrument=1, volume=100.0, spread=0.01):
    rows = [(instrument, D0 + timedelta(k), float(c), c * (1 + spread), c * (1 - spread), float(c), volume) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "instrument long, trade_date date, open double, high double, low double, close double, volume double")


def walk(n, seed):
    rng, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x *= 1 + rng.uniform(-0.03, 0.033)
        out.append(round(x, 4))
    return out


def test_windows_are_null_until_full(spark):
    rows = features.daily_features(bars(spark, range(1, 61))).orderBy("trade_date").collect()
    assert rows[18].sma_20 is None and rows[19].sma_20 == pytest.approx(10.5)
    assert rows[0].true_range is None and rows[0].daily_return is None
    assert rows[13].atr_14 is None and rows[14].atr_14 is not None
    assert rows[19].volume_ratio_20 is None and rows[20].volume_ratio_20 == pytest.approx(1.0)
    assert rows[19].volatility_20 is None and rows[20].volatility_20 is not None


def test_ties_share_the_middle(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0), (5, None)], "i long, v double").withColumn("d", F.lit(1))
    pct, n = strength.midrank(F.col("v"), "d")
    got = {r.i: (r.p, r.n) for r in df.select("i", pct.alias("p"), n.alias("n")).collect()}
    assert got == {1: (0.0, 4), 2: (0.5, 4), 3: (0.5, 4), 4: (1.0, 4), 5: (None, None)}
    one = df.where("i = 1")
    assert one.select(strength.midrank(F.col("v"), "d")[0]).first()[0] == 1.0


def test_missing_is_never_compared(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [None, None, 2.0, None]
    assert [r[0] for r in df.select(change(F.lit(1.0), finite(F.col("x")))).collect()] == [None, None, -50.0, None]
    assert [r[0] for r in spark.range(3).select(ladder(F.col("id") * 10.0, [(0, 0), (10, 50), (15, 100)])).collect()] == [0.0, 50.0, 100.0]


def test_a_missing_condition_is_a_third_status(spark):
    got = {r.status for r in trend.trend_status(bars(spark, walk(120, 1))).collect()}
    assert got == {"INSUFFICIENT_DATA"}


def test_a_close_equal_to_its_mean_is_not_above(spark):
    rows = None
    for k in range(12):
        rng = random.Random(k)
        units = [1_000_000 + rng.randrange(-30_000, 30_000) for _ in range(49)]
        units[0] -= sum(units) % 49  # the 50th, their mean, is the mean of all 50
        one = bars(spark, [u / 10_000 for u in [*units, sum(units) // 49]], instrument=k)
        rows = rows.unionByName(one) if rows else one
    got = trend.trend_conditions(rows).where("condition_id = 7 AND passed IS NOT NULL").collect()
    assert len(got) == 12 and not any(r.passed for r in got)
    day = market.breadth(market.panel(rows)).orderBy(F.desc("trade_date")).first()
    assert (day.n_50, day.above_50) == (12, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_nothing_after_a_date_is_read(spark, seed):
    whole = bars(spark, walk(340, seed)).unionByName(bars(spark, walk(340, seed + 9), 2))
    cut = D0 + timedelta(300)
    part = whole.where(F.col("trade_date") <= F.lit(cut))
    for f in (features.daily_features, trend.trend_status, trend.weekly_stage, strength.relative_strength):
        a = f(whole).where(F.col("trade_date") <= F.lit(cut))
        assert a.exceptAll(f(part)).isEmpty()
    confirmed = features.swings(whole).where(F.col("confirmed_on") <= F.lit(cut))
    assert confirmed.exceptAll(features.swings(part)).isEmpty()
    at = spark.createDataFrame([(1, cut), (2, cut)], "instrument long, as_of date")
    both = [sorted(map(str, patterns.detect_bases(x, at).collect())) for x in (whole, part)]
    assert both[0] == both[1]


def test_bitemporal_reads(spark):
    seen = spark.createDataFrame([(1, 10, 1.0), (1, 11, 1.0), (1, 12, 2.0), (2, 11, 5.0)], "k long, t int, v double")
    rows = temporal.intervals(seen, ["k"], "t", ["v"])
    assert sorted(map(tuple, rows.select("k", "v", "known_from", "known_to").collect())) == [(1, 1.0, 10, 12), (1, 2.0, 12, None), (2, 5.0, 11, None)]
    assert sorted(r.v for r in temporal.as_known(rows, F.lit(11)).collect()) == [1.0, 5.0]


def test_symmetric_difference_reads_each_side_once(spark):
    """Rows count as often as a side has more of them, nulls are equal, and neither side is read twice."""
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (3, "y")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, None), (4, None)], "k long, v string")
    got = temporal.symmetric_difference(a, b)
    assert sorted(map(str, got.collect())) == sorted(map(str, a.exceptAll(b).withColumn("side", F.lit("LEFT")).unionByName(b.exceptAll(a).withColumn("side", F.lit("RIGHT"))).collect()))
    assert sorted((r.k, r.side) for r in got.collect()) == [(1, "LEFT"), (1, "LEFT"), (3, "LEFT"), (4, "RIGHT"), (4, "RIGHT")]
    rows = spark.range(10).select("id", (F.col("id") < 6).alias("in_a"), F.when(F.col("id") > 3, True).alias("in_b"))
    parts = temporal.parted(rows, "in_a", "in_b")
    assert sorted((r.id, r.side) for r in parts.collect()) == [(k, "LEFT" if k < 4 else "RIGHT") for k in (0, 1, 2, 3, 6, 7, 8, 9)]
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    ids = temporal.symmetric_difference(spark.range(10), spark.range(5, 15))._jdf.queryExecution().optimizedPlan().toString()
    assert ids.count("Range (") == 2


def test_an_empty_dump_closes_nothing(spark):
    now = spark.createDataFrame([(1, "a")], "k long, v string")
    got = temporal.sync_dump(now, now.limit(0), "k", "v", F.current_date()).collect()
    assert [(r.action, r.v) for r in got] == [("UNCHANGED", "a")]


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, 5), (1, 7), (2, 5)], "k long, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 6, "y"), (1, 9, "z")], "k long, s int, v string")
    got = lambda df: {(r.k, r.t): r.v for r in df.collect()}
    assert got(asof.backward(left, right, ["k"], "t", "s", ["v"])) == {(1, 5): "x", (1, 7): "y", (2, 5): None}
    assert got(asof.backward(left, right, ["k"], "t", "s", ["v"], strict=True)) == {(1, 5): None, (1, 7): "y", (2, 5): None}
    assert got(asof.forward(left, right, ["k"], "t", "s", ["v"])) == {(1, 5): "y", (1, 7): "z", (2, 5): None}


def test_two_actions_on_one_day_multiply(spark):
    a = spark.createDataFrame([(1, D0 + timedelta(2), 0.5), (1, D0 + timedelta(2), 0.5), (1, D0 + timedelta(4), 0.1), (1, D0 + timedelta(5), 1.0)], "instrument long, ex_date date, factor double")
    got = {r.ex_date: round(r.cumulative, 9) for r in adjust.cumulative(a).collect()}
    assert got == {D0 + timedelta(2): 0.025, D0 + timedelta(4): 0.1}
    adjusted = [round(r.close, 6) for r in adjust.adjust(bars(spark, [100.0] * 6), a).orderBy("trade_date").collect()]
    assert adjusted == [2.5, 2.5, 10.0, 10.0, 100.0, 100.0]


def test_the_fall_goes_first_on_one_bar(spark):
    rows = [(1, D0, 100.0, 100.0, 100.0), (1, D0 + timedelta(1), 120.0, 80.0, 100.0)]
    df = spark.createDataFrame(rows, "instrument long, trade_date date, high double, low double, close double")
    assert labels.first_hit(df).orderBy("trade_date").first().hit == "DOWN"


def signal(spark, day, level):
    return spark.createDataFrame([(1, D0 + timedelta(day), float(level), 50.0)], "instrument long, trade_date date, level double, score double")


def test_trades(spark):
    closes = [100.0] * 60 + [106.0] + [110.0] * 5 + [90.0] * 5
    b = bars(spark, closes).withColumn("volume", F.when(F.col("trade_date") == F.lit(D0 + timedelta(60)), 400.0).otherwise(100.0))
    rules = [backtest.TradeRule("stop"), backtest.TradeRule("target", target_pct=3.0), backtest.TradeRule("time", horizon=2, stop_pct=50.0), backtest.TradeRule("near", max_extension_pct=5.0)]
    got = {r.rule: r for r in backtest.run_trades(b, signal(spark, 55, 105), rules).collect()}
    assert got["stop"].exit_kind == "STOP" and got["stop"].exit == pytest.approx(106 * 0.92) and got["stop"].exit_date == D0 + timedelta(66)
    assert got["target"].exit_kind == "TARGET" and got["target"].exit == pytest.approx(106 * 1.03)
    assert got["time"].exit_kind == "TIME" and got["time"].hold_bars == 2
    assert got["near"].entry == 106.0
    late = backtest.run_trades(b, signal(spark, 30, 105), [rules[0]])
    assert late.count() == 0


def test_portfolio_respects_slots(spark):
    b = bars(spark, [100.0] * 10).unionByName(bars(spark, [100.0] * 10, 2)).unionByName(bars(spark, [100.0] * 10, 3))
    t = spark.createDataFrame([("r", k, D0, D0 + timedelta(1), 100.0, D0 + timedelta(5), 100.0, "TIME", 0.0, float(k), 4) for k in (1, 2, 3)], backtest.TRADE)
    days = {r.day: r for r in backtest.portfolio(t, b, slots=2).collect()}
    assert days[D0 + timedelta(1)].n_open == 2 and days[D0 + timedelta(5)].n_open == 0 and 0.99 < days[D0 + timedelta(5)].value < 1


def test_signals_come_with_their_bars(spark):
    """Trades and scores on bars that carry the screen equal those joined from signals, and bars are read once; years are new without the year before."""
    rows = [(k, D0 + timedelta(n), 100.0 + n % 7, 99.0, 100.0 + (n * (k + 3)) % 5, 10.0 * (n % 9), "PASS" if k < 3 and n > 60 and n % 30 < 2 else "FAIL", 70 + k, 101.0) for k in range(4) for n in range(160)]
    bars_ = spark.createDataFrame(rows, "instrument long, trade_date date, high double, low double, close double, volume double, status string, rs_rank int, level double").repartition(3)
    rules = [backtest.TradeRule("a", horizon=12), backtest.TradeRule("b", target_pct=3.0)]
    signals = backtest.fresh_signals(bars_.drop("level"), bars_.select("instrument", "trade_date", "level"))
    assert signals.count() == 12 and backtest.fresh(bars_).count() == 12
    want = backtest.run_trades(bars_, signals, rules)
    got = backtest.screened_trades(bars_.select("*", *backtest.watched()), rules)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 4
    for name in ("dom57_trades", "dom54_rescored_signals", "set04_new_members"):
        from __spark_entry__ import queries

        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # Once for the bars and once for their mean.
        assert plan.count("Relation [") == 2, name
    years = spark.createDataFrame([(1, 2000), (1, 2001), (1, 2001), (1, 2003), (2, 2001), (None, 2000), (None, 2001)], "instrument long, year int")
    assert sorted((r.instrument or 0, r.year) for r in studies.new_years(years).collect()) == [(0, 2000), (0, 2001), (1, 2000), (1, 2003), (2, 2001)]


def test_base_by_hand(spark):
    """A rise, then two falls of 20 and 8 percent below one top."""
    close = legs((50, 100, 120), (100, 80, 15), (80, 97, 15), (97, 89, 10), (89, 95, 8)).tolist()
    r = patterns.detect_bases(bars(spark, close, spread=0.002), last_day(spark, close)).first()
    assert r.reason is None and r.base_start == D0 + timedelta(120) and r.advance_pct > 90
    assert [round(c.depth_pct) for c in r.contractions] == [20, 9] and all(c.confirmed for c in r.contractions)
    m = patterns.measures(patterns.detect_bases(bars(spark, close, spread=0.002), last_day(spark, close))).first()
    assert m.n == 2 and m.progressive and m.worst_ratio == pytest.approx(m.last_depth / m.first_depth)


def base_brute(close, spread, rules):
    """The base and its merged legs of the last bar, by plain loops over the bars."""
    high, low, n = [c * (1 + spread) for c in close], [c * (1 - spread) for c in close], len(close)
    edge = range(rules.left, n - rules.right)
    span = lambda x, i: x[i - rules.left : i + rules.right + 1]
    tops = [i for i in edge if high[i] == max(span(high, i)) and i > n - 1 - rules.window]
    lows = [i for i in edge if low[i] == min(span(low, i))]
    if not tops:
        return None
    start = min(tops, key=lambda i: (-high[i], i))
    tops, out = [i for i in tops if i >= start], []
    for k, i in enumerate(tops):
        end = tops[k + 1] if k + 1 < len(tops) else None
        found = [(low[j], j) for j in lows if i < j and (end is None or j <= end)]
        tail = min(low[-rules.right :])
        if end is None and i <= n - 1 - rules.right and (not found or tail < min(found)[0]):
            found = [(tail, n - 1)]
        if not found or min(found)[0] >= high[i]:
            continue
        t, j = min(found)
        d = (1 - t / high[i]) * 100
        if out and (d < rules.noise_pct or (j - i < rules.short_bars and d < rules.short_pct) or high[i] >= out[-1][0] * (1 - rules.equal_pct / 100)):
            out[-1] = (out[-1][0], min(out[-1][1], t))
        else:
            out.append((high[i], t))
    return start, [round(a, 6) for x in out for a in x]


@pytest.mark.parametrize("seed", range(3))
def test_bases_against_loops(spark, seed):
    rules, frames = patterns.BaseRules(left=3, right=2, window=60, advance_bars=40), {}
    for k in range(12):
        frames[k] = walk(150, 100 * seed + k)
    both = None
    for k, c in frames.items():
        b = bars(spark, c, k)
        both = b if both is None else both.unionByName(b)
    at = both.groupBy("instrument").agg(F.max("trade_date").alias("as_of"))
    got = {r.instrument: r for r in patterns.detect_bases(both, at, rules).collect()}
    for k, c in frames.items():
        want = base_brute(c, 0.01, rules)
        r = got[k]
        assert (r.base_start is None) == (want is None)
        if want:
            assert r.base_start == D0 + timedelta(want[0]) and [round(x, 6) for p in r.contractions for x in (p.peak, p.trough)] == want[1]


def test_bases_of_every_bar(spark):
    """As of each bar as if it were the last; 60,000 bars take seconds, not folds over arrays on each bar. A price that is null or no number is missing."""
    rules, c = patterns.BaseRules(left=3, right=2, window=60, advance_bars=40), walk(150, 77)
    got = {(r.as_of - D0).days: r for r in patterns.detect_bases(bars(spark, c), rules=rules).collect()}
    assert sorted(got) == list(range(150))
    for n, r in got.items():
        want = base_brute(c[: n + 1], 0.01, rules)
        assert (r.base_start and (r.base_start - D0).days, [round(x, 6) for p in r.contractions for x in (p.peak, p.trough)]) == (want or (None, []))
    one = bars(spark, c)
    many = one.crossJoin(spark.range(400).withColumnRenamed("id", "k")).withColumn("instrument", F.col("k")).drop("k").coalesce(1).cache()
    assert many.count() == 60_000
    began = time.time()
    assert patterns.detect_bases(many, rules=rules).agg(F.count("base_start")).first()[0] == 400 * sum(r.base_start is not None for r in got.values()) and time.time() - began < 15
    high = F.when(F.col("trade_date") == F.lit(D0 + timedelta(70)), F.lit(None)).when(F.col("trade_date") == F.lit(D0 + timedelta(75)), F.lit(float("nan"))).otherwise(F.col("high"))
    odd = one.withColumn("high", high).withColumn("instrument", F.lit(None).cast("long"))
    assert patterns.detect_bases(odd, rules=rules).where("instrument IS NULL AND NOT isnan(coalesce(base_high, 0)) AND coalesce(dayofyear(base_start), 0) NOT IN (71, 76)").count() == 150


def test_xml_filings(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><filing><entity>1</entity><period>2020-03-31</period><total_income>5</total_income><eps>1.5</eps></filing><filing><entity>2</entity><period>x</period></filing><filing><entity>3</entity><period>2020-03-31</period><eps>abc</eps></filing></r>")
    facts, rejects = facts_of_xml(spark, str(tmp_path))
    assert sorted((r.entity, r.item, r.value) for r in facts.collect()) == [(1, "eps", 1.5), (1, "revenue", 5.0)]
    assert {r.entity: r.reason for r in rejects.collect()} == {2: "no period", 3: "eps is no number"}


def legs(*points):
    import numpy as np

    return np.concatenate([np.linspace(a, b, n, endpoint=False) for a, b, n in points])


def last_day(spark, close):
    return spark.createDataFrame([(1, D0 + timedelta(len(close) + 3))], "instrument long, as_of date")


def test_new_signals(spark):
    rows = [(1, k, 10.0, k) for k in range(0, 45)] + [(1, 50, 10.0, 50), (1, 51, 11.0, 51), (1, 52, 11.0, 52)]
    df = spark.createDataFrame(rows, "instrument long, as_of int, pivot double, session int")
    assert sorted(r.as_of for r in patterns.new_signals(df).collect()) == [0, 20, 40, 50, 51]
    creep = spark.createDataFrame([(1, k, 100 + 0.009 * k, k) for k in range(6)], "instrument long, as_of int, pivot double, session int")
    assert sorted(r.as_of for r in patterns.new_signals(creep).collect()) == [0, 2, 4]


def test_base_status(spark):
    b = bars(spark, [100.0] * 60 + [90.0] * 5 + [95.0] * 5 + [103.0] * 2, spread=0.0).withColumn("volume", F.when(F.col("close") > 100, 300.0).otherwise(100.0))
    part = "array(named_struct('peak_date', date'{0}', 'peak', 100.0D, 'trough_date', date'{1}', 'trough', 90.0D, 'depth_pct', 10.0D, 'confirmed', true))".format(D0 + timedelta(59), D0 + timedelta(60))
    base = lambda day, low: spark.sql(f"SELECT 1L AS instrument, date'{D0 + timedelta(day)}' AS as_of, date'{D0 + timedelta(55)}' AS base_start, 100.0D AS base_high, {low}D AS base_low, 10.0D AS depth_pct, 10 AS n_bars, 30.0D AS advance_pct, CAST(NULL AS STRING) AS reason, {part} AS contractions")
    t = b.select("instrument", "trade_date", F.when(F.col("trade_date") == F.lit(D0 + timedelta(66)), "FAIL").otherwise("PASS").alias("status"))
    got = {r.as_of: r.state for d in (65, 66, 71) for r in patterns.base_status(base(d, 90.0), b, t).collect()}
    assert got == {D0 + timedelta(65): "FORMING", D0 + timedelta(66): "INVALIDATED", D0 + timedelta(71): "BREAKOUT"}
