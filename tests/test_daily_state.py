"""State kept from day to day: tracked breakouts, market days by month, merged bars, ledgers, validity, run records."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import adjust, backtest, flow, incremental, ledger, pivots, records, tracking
from barloom.sources import filings, store
from barloom.streaming import daily, run_available

D0 = date(2020, 1, 1)


def day(k):
    return D0 + timedelta(k)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def detection(k, base, level, pivot, close, ratio, state="FORMING", instrument=1):
    return (instrument, day(k), day(base), level, day(base), pivot, None if pivot is None else day(k - 1), close, ratio, state)


DETECTIONS = [
    detection(0, -9, 100.0, 98.0, 97.0, 1.0), detection(1, -9, 100.0, 98.0, 99.0, 2.0), detection(2, -9, 100.0, 99.0, 97.0, 1.0), detection(3, -9, 100.0, 99.0, 101.0, 2.0, "BREAKOUT"), detection(4, 3, 101.0, 100.0, 60.0, 1.0, "INVALIDATED"),
    detection(5, 3, 101.0, 100.0, 102.0, 1.6, "BREAKOUT"), detection(6, 3, 101.0, None, 100.0, None), detection(7, -9, 100.0, 98.0, 98.5, 9.0), detection(0, -5, 50.0, None, 49.0, None, instrument=2), detection(1, -5, 50.0, 49.0, 49.5, 3.0, instrument=2),
]


def test_breakouts_by_hand(spark):
    got = {(r.instrument, (r.trade_date - D0).days): r for r in tracking.track_breakouts(spark.createDataFrame(DETECTIONS, tracking.DETECTION)).collect()}
    assert (1, 4) not in got and got[1, 0].status == "FORMING" and got[1, 0].event_id is None
    first = got[1, 1]
    assert first.is_new and first.source == "PRIOR_DAY_PIVOT" and first.event_pivot == 98.0 and first.status == "BREAKOUT"
    # One event a base: a later breakout above the level is none of its own.
    assert got[1, 2].status == "FAILED" and got[1, 3].status == "BREAKOUT" and not got[1, 3].is_new and got[1, 3].event_id == first.event_id
    # The day before was of the same base but invalid: its breakout counts all the same.
    assert got[1, 5].is_new and got[1, 5].source == "STRUCTURAL" and got[1, 6].status == "FAILED"
    assert got[1, 7].event_id == first.event_id and got[1, 7].status == "BREAKOUT"
    # Without a pivot the day before there is nothing to break.
    assert got[2, 1].event_id is None


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Day by day, with a run for each, a repeated file and a late day: the same rows as in one go."""
    df = spark.createDataFrame(DETECTIONS, tracking.DETECTION)
    at, out = f"file://{tmp_path}", None
    for k in (0, 1, 1, 3, 2, 7):
        upto = {0: (0, 1), 1: (2, 3), 3: (4, 5), 2: (0, 3), 7: (6, 7)}[k]
        df.where(F.datediff("trade_date", F.lit(D0)).between(*upto)).coalesce(1).write.mode("append").parquet(f"{at}/in")
        out = run_available(daily.track_stream(daily.detection_stream(spark, f"{at}/in")), f"{at}/out", f"{at}/state")
    assert rows(out) == rows(tracking.track_breakouts(df))


def bars_frame(spark, n, instrument=1, step=1, base=100.0):
    data = [(instrument, day(k * step), base + k % 7, base + k % 7 + 1, base + k % 7 - 1, base + k % 7 + 0.5, 1000.0 + 10 * (k % 5)) for k in range(n)]
    return spark.createDataFrame(data, "instrument long, trade_date date, open double, high double, low double, close double, volume double")


def test_how_far_a_run_reads_back(spark):
    months = spark.createDataFrame([(1, f"2020-{m:02d}", 20) for m in range(1, 13)] + [(2, "2020-01", 5), (2, "2020-12", 5), (3, "2020-02", 50)], "instrument long, month string, n long")
    one = months.where("instrument = 1")
    assert incremental.reach(one, "2020-12", 20) == "2020-11" and incremental.reach(one, "2020-12", 21) == "2020-10" and incremental.reach(one, "2020-12", 1_000) == "2020-01"
    # A rare trader's bars lie far back; one that no longer trades asks for nothing.
    assert incremental.reach(months, "2020-12", 20) == "2020-01" and incremental.reach(months.where("instrument <> 2"), "2020-12", 20) == "2020-11"
    assert incremental.reach(one, "2020-01", 20) == "2020-01"


def test_a_run_reads_only_the_months_it_needs(spark, tmp_path):
    at = f"file://{tmp_path}"
    bars = bars_frame(spark, 900).unionByName(bars_frame(spark, 900, 2, base=50.0))
    sectors = spark.createDataFrame([(1, "a"), (2, "b")], "instrument long, sector string")
    cut = day(800)
    incremental.land(bars.where(F.col("trade_date") <= F.lit(cut)), f"{at}/bars")
    assert incremental.update_days(spark, f"{at}/bars", f"{at}/days", sectors) == "2020-01"
    assert incremental.update_days(spark, f"{at}/bars", f"{at}/days", sectors) is None
    before = {r.month: r.t for r in spark.read.parquet(f"{at}/days/counts").select("month", F.col("_metadata.file_modification_time").alias("t")).distinct().collect()}
    incremental.land(bars.where(F.col("trade_date") > F.lit(cut)), f"{at}/bars")
    since = incremental.update_days(spark, f"{at}/bars", f"{at}/days", sectors)
    assert since == f"{cut:%Y-%m}"
    after = {r.month: r.t for r in spark.read.parquet(f"{at}/days/counts").select("month", F.col("_metadata.file_modification_time").alias("t")).distinct().collect()}
    assert all((after[m] == t) == (str(m) < since) for m, t in before.items())
    # Bars of 2020 are older than 274 bars before the first new month: the scan leaves their folders out.
    months = spark.read.parquet(f"{at}/bars").groupBy("instrument", F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"))
    far = incremental.reach(months, incremental.reach(months, since, incremental.NEAR_BARS), incremental.FEATURE_BARS)
    plan = spark.read.parquet(f"{at}/bars").where(F.col("month") >= far)._jdf.queryExecution().executedPlan().toString()
    assert far > "2021-01" and "PartitionFilters: [isnotnull(month" in plan
    whole = incremental.stored_readings(spark, f"{at}/days", min_universe=1, min_judged=1)
    incremental.land(bars, f"{at}/all")
    incremental.update_days(spark, f"{at}/all", f"{at}/once", sectors)
    assert rows(whole) == rows(incremental.stored_readings(spark, f"{at}/once", min_universe=1, min_judged=1))


def test_sessions_to_scan(spark):
    sessions = spark.createDataFrame([(day(k),) for k in (1, 2, 3)], "trade_date date")
    none = sessions.limit(0)
    assert rows(incremental.sessions_to_scan(sessions, none)) == [(day(3),)]
    assert rows(incremental.sessions_to_scan(sessions, sessions.limit(1))) == [(day(2),), (day(3),)]
    assert rows(incremental.sessions_to_scan(sessions, sessions)) == rows(incremental.sessions_to_scan(none, none)) == []


def landing(spark, *data):
    return spark.createDataFrame([(i, day(k), c, c + 1, c - 1, float(c), 10.0, p, s, o) for i, k, c, p, s, o in data], "instrument long, trade_date date, open double, high double, low double, close double, volume double, provider string, status string, order long")


def test_merged_batches_may_run_again(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    first = landing(spark, (1, 0, 10.0, "FEED", "PROVISIONAL", 1), (1, 0, 11.0, "FEED", "PROVISIONAL", 2), (2, 0, 20.0, "FEED", "PROVISIONAL", 1), (3, 40, 30.0, "FEED", "PROVISIONAL", 1), (None, 0, 1.0, "FEED", "PROVISIONAL", 1))
    second = landing(spark, (1, 0, 12.0, store.FINAL, "OK", 1), (1, 0, 13.0, "FEED", "PROVISIONAL", 2), (2, 0, 20.0, "FEED", "PROVISIONAL", 1), (2, 1, -5.0, "FEED", "PROVISIONAL", 1))
    store.merge_batch(spark, path, first, 0)
    store.merge_batch(spark, path, second, 1)
    want = [(1, 10.0, 0, 0), (1, 11.0, 0, 1), (1, 12.0, 1, None), (2, 20.0, 0, None), (3, 30.0, 0, None)]
    got = lambda: rows(spark.read.parquet(path), "instrument", "close", "batch_from", "batch_to")
    assert got() == sorted(want, key=repr)
    store.merge_batch(spark, path, second, 1)
    assert got() == sorted(want, key=repr)
    store.merge_batch(spark, path, second.limit(0), 2)
    assert got() == sorted(want, key=repr)


def test_rewritten_bars_are_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/adjusted"
    save = lambda prune, *data: store.rewrite_adjusted(spark, path, spark.createDataFrame([(i, day(k), v, s, c, at) for i, k, v, s, c, at in data], "instrument long, trade_date date, version string, snapshot string, close double, computed_at int"), prune)
    save(True, (1, 0, "a", None, 1.0, 1), (1, 1, "a", None, 2.0, 1), (1, 0, "a", "s", 3.0, 1), (2, 0, "a", None, 4.0, 1))
    save(False, (1, 0, "a", None, 9.0, 2), (1, 0, "a", None, 8.0, 1))
    got = lambda: rows(spark.read.parquet(path), "instrument", "trade_date", "version", "snapshot", "close")
    rest = [(1, day(0), "a", "s", 3.0), (2, day(0), "a", "LIVE", 4.0)]
    assert got() == sorted([(1, day(0), "a", "LIVE", 9.0), (1, day(1), "a", "LIVE", 2.0), *rest], key=repr)
    for _ in range(2):
        save(True, (1, 1, "a", None, 5.0, 3), (1, 0, "b", None, 6.0, 3))
        assert got() == sorted([(1, day(1), "a", "LIVE", 5.0), (1, day(0), "b", "LIVE", 6.0), *rest], key=repr)


def test_pivots_by_hand(spark):
    """Tops of 100, 99 and 90: two form one level; the zone is visited, left and closed above at last."""
    high = [50.0] * 6 + [100.0] + [80.0] * 6 + [99.0] + [85.0] * 6 + [90.0] + [70.0] * 6 + [99.5, 88.0]
    data = [(1, day(k), h, h - 5, h - 1) for k, h in enumerate(high)]
    bars = spark.createDataFrame(data, "instrument long, trade_date date, high double, low double, close double")
    bases = spark.createDataFrame([(1, day(6), day(len(high) - 1))], "instrument long, base_start date, as_of date")
    got = {r.source: r for r in pivots.pivots(bars, bases).collect()}
    assert set(got) == {"BASE_HIGH", "LAST_PEAK", "RIGHT_SIDE_HIGH", "REPEATED"}
    assert (got["REPEATED"].pivot, got["REPEATED"].pivot_date) == (100.0, day(13)) and got["LAST_PEAK"].pivot == 90.0 and got["RIGHT_SIDE_HIGH"].pivot == 99.5
    assert (got["BASE_HIGH"].touches, got["BASE_HIGH"].rejections) == (3, 3)
    assert got["LAST_PEAK"].is_structural and got["LAST_PEAK"].is_primary and got["LAST_PEAK"].touches == 4 and got["LAST_PEAK"].rejections == 1
    assert got["RIGHT_SIDE_HIGH"].tightness_pct == pytest.approx((1 - 83 / 88) * 100)


def test_validity_over_days_without_a_list(spark):
    lists = spark.createDataFrame([(day(k), i, f) for k, i, f in [(0, 1, "A"), (1, 1, "A"), (3, 1, "A"), (4, 1, "B"), (0, 2, "A"), (0, 2, "A"), (2, 3, "A"), (4, 3, "A"), (4, None, "A")]], "day date, instrument long, flag string")
    fetched = spark.createDataFrame([(day(k),) for k in (0, 1, 3, 4, 5)], "day date")
    # No list was fetched on day 2: what held goes on, and what stands in a list of that day is not known.
    want = [(1, "A", day(0), day(4), 3), (1, "B", day(4), day(5), 1), (2, "A", day(0), day(1), 1), (3, "A", day(4), day(5), 1)]
    assert rows(records.validity(lists, fetched), "instrument", "flag", "valid_from", "valid_to", "n_lists") == sorted(want, key=repr)
    assert rows(records.validity(lists, fetched.where(F.col("day") < day(5))), "instrument", "flag", "valid_to")[1] == (1, "B", None)


def test_runs_are_verified_by_digest(spark):
    data = [("a", 1, "x"), ("a", 2, None), ("a", 2, None), ("b", 1, "y"), ("c", 1, "z")]
    kept = spark.createDataFrame(data, "m string, n long, s string")
    record = records.run_records(kept, "m", "v1", kept)
    again = rows(record) == rows(records.run_records(kept.repartition(3), "m", "v1", kept.repartition(2)))
    rebuilt = spark.createDataFrame([*data[:2], ("b", 1, "y"), ("b", 2, "new")], "m string, n long, s string")
    assert again and rows(records.verify_runs(record, kept, rebuilt, "m"), "m", "state", "n_missing", "n_extra") == [("a", "DIFFERS", 1, 0), ("b", "DIFFERS", 0, 1), ("c", "NOT_REBUILT", 0, 0)]
    assert {r.state for r in records.verify_runs(record, kept, kept.repartition(4), "m").collect()} == {"MATCH"}


def test_factors_of_one_day(spark):
    """Published cases: rights of 1:14 at 535 on 739.40 give 0.98157, a demerger at 2580 on 2841.85 gives 0.9079."""
    cases = [
        (1, "RIGHTS", 1.0, 14.0, 535.0, 739.40, 700.0, True), (2, "DEMERGER", None, None, None, 2841.85, 2580.0, True), (3, "SPLIT", 2.0, 1.0, None, 100.0, 51.0, True), (3, "RIGHTS", 1.0, 1.0, 40.0, 100.0, 51.0, True), (4, "BONUS", 1.0, 1.0, None, 100.0, 99.0, True),
        (5, "SPLIT", 2.0, 1.0, None, 100.0, 50.0, True), (5, "UNMODELLED", None, None, None, 100.0, 50.0, True), (6, "DEMERGER", None, None, None, 100.0, 90.0, False), (7, "DEMERGER", 0.8, 1.0, None, None, None, None), (8, "RIGHTS", 1.0, 4.0, 200.0, 100.0, 99.0, True), (9, "DEMERGER", None, None, None, 100.0, 105.0, True),
        (10, "BONUS", 1.0, 9.0, None, 100.0, 100.0, True),
    ]
    priced = spark.createDataFrame([(i, D0, *rest) for i, *rest in cases], "instrument long, ex_date date, kind string, num double, den double, price double, prior_close double, ex_open double, raw boolean")
    got = {(r.instrument, r.kind): (r.state, None if r.price_factor is None else round(r.price_factor, 5)) for r in adjust.day_factors(priced).collect()}
    assert got[1, "RIGHTS"] == ("APPLIED", 0.98157) and got[2, "DEMERGER"] == ("APPLIED", 0.90786) and got[3, "SPLIT"] == ("APPLIED", 0.5)
    # The close before stands at 50 after the split, and rights at 40 are worth (50 + 40) / 2 on it.
    assert got[3, "RIGHTS"] == ("APPLIED", 0.9) and got[4, "BONUS"] == ("UNCONFIRMED", None) and got[5, "SPLIT"] == ("SUPERSEDED", None) and got[5, "UNMODELLED"] == ("UNMODELLED", None)
    assert got[6, "DEMERGER"] == ("NOT_RAW", None) and got[7, "DEMERGER"] == ("APPLIED", 0.8) and got[8, "RIGHTS"] == ("APPLIED", 1.0) and got[9, "DEMERGER"] == ("UNKNOWN", None) and got[10, "BONUS"] == ("APPLIED", 0.9)


def test_results_known_late_enough(spark):
    sessions = spark.createDataFrame([(day(k), k + 1) for k in range(8)], "trade_date date, session int")
    bars = spark.createDataFrame([(1, day(k), c) for k, c in enumerate([10.0, 11.0, 11.0, 9.0, 12.0, 12.0, 12.0, 12.0])], "instrument long, trade_date date, close double")
    events = spark.createDataFrame([(1, day(1), 10.5), (1, day(1), 10.0), (1, day(2), 8.0), (1, day(4), 12.0)], "instrument long, day date, level double")
    got = {(r.day - D0).days: (r.known, r.failed) for r in flow.judged_events(events, bars, sessions).collect()}
    assert got == {1: (4, True), 2: (8, False)}


def test_ledger_by_hand(spark):
    bars = bars_frame(spark, 12)
    signals = spark.createDataFrame([(1, day(k), 5.0) for k in (0, 1, 5, 8)], "instrument long, trade_date date, score double")
    trade = ("r", 1, day(1), day(3), 101.0, day(6), 99.0, "STOP", -2.0, 5.0, 3)
    lost = ("r", 2, day(1), day(3), 50.0, day(6), 49.0, "STOP", -2.0, 5.0, 3)
    trades = spark.createDataFrame([trade, lost], backtest.TRADE)
    taken = trades.where("instrument = 1").select("rule", "instrument", "entry_date")
    rules = spark.createDataFrame([("r", 2)], "rule string, watch int")
    events = ledger.ledger(ledger.watches(signals, trades, bars, rules), trades, taken, bars.select("trade_date").limit(2))
    got = rows(events.where("event_type <> 'DAY_CLOSED'"), "event_type", "instrument", "event_date", "note")
    # The signal of day 5 lies in the trade; that of day 8 is watched for two bars; the first is replaced by the second.
    assert got == sorted([("WATCH", 1, day(0), "5.0"), ("WATCH", 1, day(1), "5.0"), ("WATCH", 1, day(8), "5.0"), ("WATCH_EXPIRED", 1, day(1), "REPLACED"), ("WATCH_EXPIRED", 1, day(10), "NO_BREAKOUT"), ("ENTRY", 1, day(3), None), ("EXIT", 1, day(6), "STOP"), ("SKIPPED_NO_SLOT", 2, day(3), None)], key=repr)
    assert events.where("event_type = 'DAY_CLOSED'").count() == 2
    state = ledger.status(events).first()
    assert (state.closed, state.win_rate, state.avg_ret, state.profit_factor, state.n_open, state.skipped) == (1, 0.0, -2.0, 0.0, 0, 1)


def test_closed_days_are_never_written(spark, tmp_path):
    make = lambda *data: spark.createDataFrame([("r", 1, day(k), t, day(k), p, None, None) for k, t, p in data], ledger.EVENT)
    derived = make((1, "ENTRY", 1.0), (1, "DAY_CLOSED", None), (2, "ENTRY", 2.0), (2, "DAY_CLOSED", None), (3, "ENTRY", 3.0))
    stored = make((1, "ENTRY", 1.00001), (1, "DAY_CLOSED", None), (2, "ENTRY", 2.5), (2, "DAY_CLOSED", None), (2, "DIVERGENCE", None))
    update = ledger.plan_update(derived, stored)
    assert rows(update, "state", "event_date", "price") == [("DERIVED_ONLY", day(2), 2.0), ("NEW", day(3), 3.0), ("STORED_ONLY", day(2), 2.5)]
    path = f"file://{tmp_path}/ledger"
    stored.write.parquet(path)
    ledger.append_update(update, path)
    assert rows(spark.read.parquet(path).exceptAll(stored), "event_date", "price") == [(day(3), 3.0)]
    assert ledger.plan_update(derived, stored.limit(0)).where("state = 'NEW'").count() == 5


def test_filings_of_any_shape(spark):
    docs = [
        ("a", '<x xmlns:r="r"><context id="OneD"><p><startDate>2020-04-01</startDate><endDate>2020-09-30</endDate></p></context><r:ProfitLossForPeriod contextRef="OneD">1,000</r:ProfitLossForPeriod><r:ProfitLossForPeriod contextRef="OneD">7</r:ProfitLossForPeriod><r:Odd contextRef="OneD">x</r:Odd></x>'),
        ("b", "<x>"), ("c", None), ("d", ""), ("e", "<x/>"), ("f", '<!DOCTYPE x [<!ENTITY a "b">]><x/>'),
    ]
    facts = filings.xml_facts(spark.createDataFrame(docs, "doc string, content string"))
    heads, items, rejects = filings.result_filings(facts)
    head = heads.first()
    # A half year is a year to date, and its quarter is empty.
    assert (head.doc, head.starts, head.ends, head.ytd_starts, head.period_type) == ("a", date(2020, 7, 1), date(2020, 9, 30), date(2020, 4, 1), "QUARTER")
    assert rows(items) == [("a", "YTD", "net_profit", 1000.0)]
    assert dict(rows(rejects)) == {"b": "not XML", "c": "no document", "d": "no document", "e": "no reporting period", "f": "declares entities"}
