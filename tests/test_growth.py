"""Jobs whose cost must not grow faster than the bars: what they do beside their rows."""

import statistics
from datetime import date, timedelta
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import health, incremental, market, pivots, strength, tracking
from barloom.plans import streams
from barloom.sources import store
from barloom.streaming import daily

D0 = date(2020, 1, 1)
BAR = "instrument long, trade_date date, open double, high double, low double, close double, volume double"


def day(k):
    return D0 + timedelta(k)


def bar(i, k, h):
    return (i, day(k), h, h, h and h - 3, h and h - 1 - k % 2, 10.0 + k % 7)


def highs(i, n):
    return [None if (k + i) % 37 == 5 else 100.0 + (k * k * (i + 3) + 5 * k) % 23 for k in range(n)]


def levels(hs, first, last):
    """(pivot, place): (touches, rejections) of a base, by loops over its bars."""
    bars = [bar(0, k, h) for k, h in enumerate(hs)]
    num = lambda x: -1.0 if x is None else x
    swings = [k for k in range(max(first, 5), last - 4) if hs[k] is not None and hs[k] >= max(num(h) for h in hs[k - 5 : k + 6])]
    found = {(hs[first], first), max(((hs[k], k) for k in range(max(first, last - 9), last + 1)), key=lambda x: (num(x[0]), x[1]))}
    if swings and swings[-1] > first:
        found.add((hs[swings[-1]], swings[-1]))
    tops = []
    for h, k in sorted((-hs[k], k) for k in swings):
        if tops and -h >= tops[-1][0] * (1 - 1.5 / 100):
            tops[-1][1].append(k)
        else:
            tops.append((-h, [k]))
    found |= {(top, max(ks)) for top, ks in tops if len(ks) > 1}
    out = {}
    for pivot, at in found:
        inside = [pivot is not None and hs[k] is not None and hs[k] >= pivot * (1 - 1.5 / 100) for k in range(first, last + 1)]
        runs, k = [], 0
        while k < len(inside):
            b = k
            while k < len(inside) and inside[k]:
                k += 1
            runs += [(first + b, first + k - 1)] * (k > b)
            k += k == b
        failed = [r for r in runs if r[1] < last and not any(bars[k][5] > pivot for k in range(r[0], r[1] + 1))]
        out[pivot, at] = (len(runs), len(failed))
    return out


def test_bases_are_not_spread_over_their_bars(spark):
    data = {i: highs(i, 120 + 7 * i) for i in range(6)}
    bars = spark.createDataFrame([bar(i, k, h) for i, hs in data.items() for k, h in enumerate(hs)], BAR)
    spans = [(i, a, b) for i, hs in data.items() for a, b in [(0, 0), (0, len(hs) - 1), (5, 40), (32, 33), (17, 80), (60, 110), (61, 110)]]
    bases = spark.createDataFrame([(i, day(a), day(b)) for i, a, b in [*spans, (0, 9, 5), (1, 5, 5_000), (77, 1, 2)]], "instrument long, base_start date, as_of date")
    got = pivots.pivots(bars, bases)
    want = {(i, day(a), day(b), day(at), p): v for i, a, b in spans for (p, at), v in levels(data[i], a, b).items()}
    assert {(r.instrument, r.base_start, r.as_of, r.pivot_date, r.pivot): (r.touches, r.rejections) for r in got.collect()} == want and got.count() == len(want)
    # Some twenty bars a level, met one by one, were most of the work.
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_shares_of_bases(monkeypatch):
    monkeypatch.setattr(pivots, "HELD", 10)
    assert list(pivots.shares(pivots.np.array([4, 6, 1, 30, 9, 1, 1]))) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]


def test_detections_of_many_bars_at_once(spark):
    """Against a loop; a missing high is no pivot, and leaves spans with it without a row."""
    hs = [100.0 + (k * k + 3 * k) % 11 for k in range(150)]
    hs[140] = None
    bars = spark.createDataFrame([bar(1, k, h) for k, h in enumerate(hs)] + [bar(2, k, h) for k, h in enumerate(hs[:55])], BAR)
    got = tracking.daily_detections(bars)
    best = lambda a, b: min((-hs[k], k) for k in range(a, b) if hs[k] is not None)
    ratio = lambda k: (10.0 + k % 7) / (sum(10.0 + j % 7 for j in range(k - 50, k)) / 50)
    want = [(1, day(k), day(best(k - 55, k - 5)[1]), -best(k - 55, k - 5)[0], -best(k - 5, k)[0], day(best(k - 5, k)[1]), ratio(k)) for k in range(55, 146)]
    assert sorted(tuple(r) for r in got.select("instrument", "trade_date", "base_start", "level", "pivot", "pivot_date", "ratio").collect()) == want
    assert got.where(F.col("close").isNull()).select("trade_date", "state").collect() == [(day(140), "FORMING")]
    # Only the numbering is a window of Spark's; frames of 50 bars were looked through anew on each bar.
    assert "RowFrame" not in got._jdf.queryExecution().optimizedPlan().toString().replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())", "")


def test_an_event_is_looked_up_once_a_run(spark):
    """Two runs over 40 days of one base and 40 of another: each day asked the state twice."""
    held, kept, asked = {}, [None], []
    events = SimpleNamespace(getValue=lambda b: asked.append(b) or held.get(b), updateValue=held.__setitem__)
    tracker = daily.BreakoutTracker("default", 1.5)
    tracker.init(SimpleNamespace(getValueState=lambda *a: SimpleNamespace(get=lambda: kept[-1], update=kept.append), getMapState=lambda *a: events))
    base = lambda k: day(-9) if k < 40 else day(35)
    data = [(1, day(k), base(k), 100.0, base(k), 98.0, day(k - 1), 101.0 if k in (7, 50) else 97.0, 2.0, "BREAKOUT" if k in (7, 50) else "FORMING") for k in range(80)]
    columns = [c.split()[0] for c in tracking.DETECTION.split(", ")]
    parts = [pd.DataFrame(rows, columns=columns) for rows in (data[:20], data[15:60], data[60:])]
    got = [tuple(None if x != x else x for x in r) for part in parts for out in tracker.handleInputRows((1,), iter([part]), None) for r in out.itertuples(index=False, name=None)]
    want = tracking.track_breakouts(spark.createDataFrame(data, tracking.DETECTION)).orderBy("trade_date").collect()
    assert got == [tuple(r) for r in want] and len(got) == 80
    # The second run asks for the first base only, as the other one starts behind day 19; the third for the other.
    assert asked == [(day(-9),), (day(35),)]


def test_a_month_is_not_written_by_each_task(spark, tmp_path):
    """Forty days of two months in eight tasks: they wrote each month in up to eight files."""
    data = [(i, day(k), 10.0, 11.0, 9.0, 10.0, 5.0, "FEED", "PROVISIONAL", 1) for i in range(200) for k in range(40)]
    come = spark.createDataFrame(data, "instrument long, trade_date date, open double, high double, low double, close double, volume double, provider string, status string, order long")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.merge_batch(spark, f"file://{tmp_path}/bars", come, 0)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"file://{tmp_path}/bars").count() == len(data)
    assert {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "bars").glob("month=*")} == {"month=2020-01": 1, "month=2020-02": 1}


def frame(rows, k, c, n):
    """Values that are there in the last n rows up to k."""
    return [r[c] for r in rows[k - n + 1 : k + 1] if r[c] is not None] if k >= n - 1 else []


def test_frames_of_many_bars_at_once(spark):
    """Against loops, with missing numbers; windows of 252 bars went through their frame anew on each bar."""
    data = {}
    for i, n in ((1, 330), (2, 30), (3, 1), (4, 300)):
        rows = [list(bar(i, k, 100.0 + (k * k + 7 * i * k) % 43)) for k in range(n)]
        for k in range(9, n, 31):
            rows[k][3 + k % 4] = None
        data[i] = [tuple(r) for r in rows]
    whole = spark.createDataFrame([r for rows in data.values() for r in rows], BAR).repartition(3)
    panel = market.panel(whole)
    assert "RowFrame, -" not in panel._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.instrument, r.trade_date): r for r in panel.collect()}
    assert len(got) == sum(map(len, data.values()))
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for i, rows in data.items():
        for k, row in enumerate(rows):
            r = got[i, row[1]]
            assert [r[f"sma_{n}"] for n in (20, 50, 150, 200)] == [mean(frame(rows, k, 5, n)) for n in (20, 50, 150, 200)]
            assert [r[f"high_{n}"] for n in (20, 50, 252)] == [max(frame(rows, k, 3, n), default=None) for n in (20, 50, 252)]
            assert [r[f"low_{n}"] for n in (20, 50, 252)] == [min(frame(rows, k, 4, n), default=None) for n in (20, 50, 252)]
            before = frame(rows, k - 1, 6, 20)
            assert r.volume_ratio_20 == (row[6] / mean(before) if len(before) == 20 and row[6] is not None else None)
            steps = [b[5] / a[5] - 1 if a[5] and b[5] is not None else None for a, b in zip(rows[max(0, k - 20) : k], rows[max(1, k - 19) : k + 1], strict=True)]
            assert (r.volatility_20 is not None) == (len(steps) == 20 and None not in steps)
            assert r.volatility_20 is None or abs(r.volatility_20 - statistics.pstdev(steps)) < 1e-12
            after = [x[5] for x in rows[k + 1 : k + 11]]
            closes = [c for c in after if c is not None]
            assert (r.n_after, r.low_judged, r.close_judged) == (len(closes), min(closes, default=None), after[9] if len(after) == 10 else None)
            assert (r.led_on, r.led_close) == ((rows[k + 20][1], rows[k + 20][5]) if k + 20 < len(rows) else (None, None))
    since = day(290)
    late = {(r.instrument, r.trade_date): r for r in market.panel(whole, since=since).collect()}
    assert late == {key: r for key, r in got.items() if key[1] >= since}


def test_ranks_of_a_day_take_one_pass(spark):
    """Each of three counts went through the day's rows by itself."""
    df = spark.createDataFrame([(k % 3, float(k * k % 5) if k % 7 else None) for k in range(60)], "d int, v double")
    got = df.select("d", "v", *[c.alias(n) for c, n in zip(strength.midrank(F.col("v"), "d"), ("pct", "n"), strict=True)])
    for r in got.collect():
        group = [x.v for x in df.collect() if x.d == r.d and x.v is not None]
        want = (None, None) if r.v is None else ((sum(v < r.v for v in group) + 0.5 * (group.count(r.v) - 1)) / (len(group) - 1), len(group))
        assert (r.pct, r.n) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_days_do_not_meet_the_days_before(spark):
    """A leader of a day counts on the day that its row names; the panel's bars met by instrument for it."""
    data = [(i, day(k), 50.0 + k + i, i != 3, k + 20) for i in range(4) for k in range(30)]
    rows = [(i, d, c, c, c, c, 10.0, 0.01, "PASS" if led else "FAIL", 90, True, day(on) if on < 30 else None, 50.0 + on + i if on < 30 else None) for i, d, c, led, on in data]
    names = "instrument long, trade_date date, open double, high double, low double, close double, volume double, daily_return double, status string, rs_rank int, eligible boolean, led_on date, led_close double"
    rest = [c for c in health.PANEL if c not in names]
    panel = spark.createDataFrame(rows, names).withColumns({c: F.lit(None).cast("double") for c in rest})
    counts = health.day_counts(panel)
    got = {r.trade_date: (r.leaders, r.led_n, r.led_return) for r in counts.collect()}
    for k in range(30):
        then = [50.0 + k - 20 + i for i in range(3)] if k >= 20 else []
        assert got[day(k)][:2] == (3, len(then))
        assert got[day(k)][2] is None if not then else abs(got[day(k)][2] - sum((c + 20) / c - 1 for c in then) / 3) < 1e-12
    assert "Window" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_bars_are_worked_out_once_for_all_landings(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(streams, "model_bars", lambda s, d: asked.append(d) or s.createDataFrame(ticked, BAR).withColumn("close", counted("close")))
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "double").asNondeterministic()
    ticked = [(1, date(1996, 6, 1) + timedelta(100 * k), 1.0, 2.0, 0.5, 1.0 + k, 9.0) for k in range(6)]
    counts = [spark.read.parquet(f"{at}/bars").count() for at in streams.landed(spark, "none")]
    assert counts == [1, 4, 6] and asked == ["none"] and seen.value == 6


def test_a_landing_is_not_written_by_each_task(spark, tmp_path):
    bars = spark.createDataFrame([bar(i, k, 100.0) for i in range(200) for k in range(60)], BAR).repartition(4, "instrument")
    incremental.land(bars, f"file://{tmp_path}/bars")
    assert {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "bars").glob("month=*")} == {"month=2020-01": 1, "month=2020-02": 1}
    assert spark.read.parquet(f"file://{tmp_path}/bars").count() == 200 * 60
