"""What a job keeps on disk: side copies, and rows that are dealt out more often than need be."""

from __future__ import annotations

from datetime import date, timedelta

from barloom.operators import ledger, patterns
from barloom.operators.backtest import TRADE, TradeRule, run_trades
from barloom.plans import records, research
from barloom.sources import filings, store

D0 = date(2020, 1, 1)


def day(k):
    return D0 + timedelta(days=k)


def exchanges(rows):
    """Exchanges of the plan of rows that have not been computed yet, and those that are used again."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("ReusedExchange")


def come(spark, up, provider, status):
    data = [(i, day(k), 10.0, 12.0, 9.0, 10.0 + up * (i % 3), 5.0, provider, status, 1) for i in range(40) for k in range(40)]
    return spark.createDataFrame(data, "instrument long, trade_date date, open double, high double, low double, close double, volume double, provider string, status string, order long")


def test_a_merge_deals_rows_out_once_and_leaves_no_copy(spark, tmp_path, monkeypatch):
    """Each batch left a copy of its months beside the table, after two shuffles of all their versions."""
    got = []
    for name, bars in (("whole", store.MONTH_BARS), ("shared", 100)):
        monkeypatch.setattr(store, "MONTH_BARS", bars)
        path = f"file://{tmp_path}/{name}/bars"
        for k, rows in enumerate((come(spark, 1.0, "FEED", "PROVISIONAL"), come(spark, 0.0, store.FINAL, "OK").where("instrument % 5 <> 0"), come(spark, 0.0, "FEED", "PROVISIONAL"))):
            store.merge_batch(spark, path, rows, k)
        assert [p.name for p in (tmp_path / name).iterdir()] == ["bars"]
        stored = spark.read.parquet(path)
        got.append(sorted(map(tuple, stored.select("instrument", "trade_date", "close", "batch_from", "batch_to").collect()), key=repr))
    assert got[0] == got[1] and len(got[0]) == 40 * 40 + 32 * 40 + 5 * 40
    assert exchanges(store.merged_versions(stored.drop("month"), come(spark, 2.0, "FEED", "PROVISIONAL"), 3)) == (1, 0)
    assert spark.conf.get(store.RELEASE) == "false"


def plain_status(bars, base, ratio=1.5):
    """(floor, close, breakout_on) of one base by the bars up to its day, in a loop."""
    day, start, level, level_day = base
    floor, broke, close = None, None, None
    for k, (d, low, c, _) in enumerate(bars):
        if not start <= d <= day:
            continue
        close = c
        if d <= level_day and low is not None:
            floor = low if floor is None else min(floor, low)
        before = [b[3] for b in bars[max(0, k - 50) : k]]
        loud = len(before) == 50 and None not in before and sum(before) > 0 and bars[k][3] is not None and bars[k][3] / (sum(before) / 50) >= ratio
        if broke is None and d > level_day and c is not None and c > level and loud:
            broke = d
    return floor, close, broke


def test_a_base_is_not_spread_over_its_bars(spark):
    """Each base became a row for each of its bars, which were dealt out; against a loop, with missing numbers and days without a bar."""
    data = {}
    for i in (1, 2, 5):
        data[i] = [(day(k), None if k % 37 == 5 else 90.0 + (k * k + i) % 17, None if k % 41 == 7 else 95.0 + (k * k + 3 * i * k) % 23, None if k % 97 == i else 100.0 + 200 * (k % 6 == i)) for k in range(0, 160 + 20 * i) if k % 7 != 6]
    b = spark.createDataFrame([(i, *r) for i, rows in data.items() for r in rows], "instrument long, trade_date date, low double, close double, volume double")
    asked = [(i, day(k), day(s), 100.0 + s % 15, day(s + n)) for i in (1, 2, 5, 9) for k, s, n in ((100, 70, 10), (104, 71, 0), (170, 99, 20), (150, 65, 30), (400, 120, 13), (160, 69, 3)) if s % 7 != 6 or i == 2]
    part = "array(named_struct('peak_date', peak_date, 'peak', peak, 'trough_date', peak_date, 'trough', 1.0D, 'depth_pct', 10.0D, 'confirmed', true))"
    bases = spark.createDataFrame(asked, "instrument long, as_of date, base_start date, peak double, peak_date date").selectExpr("instrument", "as_of", "base_start", "peak AS base_high", "CAST(NULL AS STRING) AS reason", f"{part} AS contractions")
    trend = b.selectExpr("instrument", "trade_date", "'PASS' AS status")
    got = patterns.base_status(bases, b, trend)
    want = {}
    for i, at, start, level, level_day in asked:
        if any(r[0] == start for r in data.get(i, [])):
            floor, close, broke = plain_status(data[i], (at, start, level, level_day))
            want[i, at] = (level, broke, "BREAKOUT" if broke and close is not None and close >= level else "FAILED" if broke else "FORMING")
    assert {(r.instrument, r.as_of): (r.level, r.breakout_on, r.state) for r in got.collect()} == want
    assert sum(w[1] is not None for w in want.values()) >= 3 and len(want) < len(asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_month_ends_alone_are_made_and_moved(spark):
    """All bars' bases were joined to the months' last bars; they are now asked for on these, and nothing is joined."""
    got = research.month_bases(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert got.groupBy("instrument", "as_of").count().where("count > 1").isEmpty() and got.where("as_of <> last_day(as_of)").isEmpty() and got.count() > 100


def test_bars_are_screened_once_for_the_flow_of_setups(spark):
    """The screen stood five times in the plan of its days."""
    rows = records.setup_flow(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() > 0


def test_a_ledger_makes_its_trades_once(spark):
    """Trades, and the screen below them, stood in each part of the ledger, and each bar carried a list of the days behind it."""
    rows = research.ledger_of(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("MapInArrow", "InPandas")) and rows.where("event_type = 'DAY_CLOSED'").count() > 0
    bars = spark.createDataFrame([(1, day(k)) for k in range(30)], "instrument long, trade_date date")
    signals = spark.createDataFrame([(1, day(2), 1.0), (1, day(20), 2.0)], "instrument long, trade_date date, score double")
    rules = spark.createDataFrame([("a", 3), ("b", 12), ("c", 18), ("d", 0), ("e", None)], "rule string, watch int")
    watched = ledger.watches(signals, spark.createDataFrame([], TRADE), bars, rules)
    assert "collect_list" not in watched._jdf.queryExecution().executedPlan().toString()
    ends = {(r.rule, r.signal_date): (r.ends, r.why) for r in watched.collect()}
    want = {("a", 2): (5, "NO_BREAKOUT"), ("a", 20): (23, "NO_BREAKOUT"), ("b", 2): (14, "NO_BREAKOUT"), ("b", 20): (None, None), ("c", 2): (20, "REPLACED"), ("c", 20): (None, None)}
    want |= {(rule, k): (20, "REPLACED") if k == 2 else (None, None) for rule in "de" for k in (2, 20)}
    assert ends == {(rule, day(k)): (None if at is None else day(at), why) for (rule, k), (at, why) in want.items()}


def test_signals_meet_their_bars_by_instrument(spark):
    """Bars with signals were dealt out by day and again by instrument."""
    bars = spark.createDataFrame([(i, day(k), 100.0 + k, 99.0 + k, 100.0 + k, 200.0 if k % 9 == 0 else 100.0) for i in (1, 2, 3) for k in range(120)], "instrument long, trade_date date, high double, low double, close double, volume double")
    signals = spark.createDataFrame([(1, day(60), 161.0, 5.0), (2, day(7), 101.0, 5.0), (2, None, 101.0, 5.0), (9, day(60), 1.0, 1.0)], "instrument long, trade_date date, level double, score double")
    got = run_trades(bars, signals, [TradeRule("x", horizon=10)])
    assert [(r.instrument, r.signal_date, r.entry_date, r.hold_bars, r.score) for r in got.collect()] == [(1, day(60), day(63), 10, 5.0)]
    assert ", trade_date" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x)


def test_facts_of_a_filing_come_together_once(spark):
    """Headers, items and rejects dealt facts out by document, scope and tag, and again for each part of theirs."""
    element = "<r:{} contextRef='{}'>{}</r:{}>"
    fact = lambda tag, context, value: element.format(tag, context, value, tag)
    context = lambda name, a, b: f"<context id='{name}'><p><startDate>{a}</startDate><endDate>{b}</endDate></p></context>"
    text = {
        # The year to date repeats the period; the first fact of a tag counts, and the first tag with a number.
        "a": context("OneD", "2020-04-01", "2020-06-30") + context("FourD", "2020-04-01", "2020-06-30") + fact("ProfitBeforeTax", "OneD", "none") + fact("ProfitBeforeTax", "OneD", 9) + fact("ProfitLossFromOrdinaryActivitiesBeforeTax", "OneD", 8) + fact("Income", "FourD", 5),
        # A half year beside a year to date of its own; days told by facts.
        "b": context("OneD", "2020-04-01", "2020-09-30") + context("FourD", "2020-04-01", "2020-12-31") + fact("RevenueFromOperations", "OneD", 3) + fact("RevenueFromOperations", "FourD", 4) + fact("DateOfEndOfReportingPeriod", "FourD", "2020-12-30"),
        "c": context("OneD", "2019-04-01", "2020-03-31") + fact("Income", "OneD", 5) + fact("BorrowingsCurrent", "OneI", 2) + fact("NatureOfReportStandaloneConsolidated", "OneD", " Standalone "),
        "d": context("OneD", "2020-04-01", "2020-03-31") + fact("Income", "OneD", 5),
        "e": fact("Income", "OneX", 5),
    }
    facts = filings.xml_facts(spark.createDataFrame([(k, f"<x xmlns:r='r'>{v}</x>") for k, v in text.items()], "doc string, content string"))
    heads, items, rejects = filings.result_filings(facts)
    assert [exchanges(x) for x in (heads, items, rejects)] == [(1, 0)] * 3
    assert sorted(tuple(r) for r in items.collect()) == [("a", "PERIOD", "pbt", 8.0), ("b", "YTD", "revenue", 4.0), ("c", "INSTANT", "borrowings", 2.0), ("c", "PERIOD", "revenue", 5.0)]
    assert sorted((r.doc, r.basis, str(r.starts), str(r.ytd_ends), r.period_type, r.is_financial) for r in heads.collect()) == [
        ("a", None, "2020-04-01", "None", "QUARTER", False), ("b", None, "2020-07-01", "2020-12-30", "QUARTER", False), ("c", "STANDALONE", "2019-04-01", "None", "ANNUAL", True),
    ]
    assert sorted(r.doc for r in rejects.collect()) == ["d", "e"]
