"""Universe rules, survivorship and factor sets on hand-made frames."""

from datetime import date, timedelta

from barloom.operators import adjust, market, universe

DAY = date(2024, 1, 1)
BARS = "instrument long, trade_date date, close double, volume double, series string, exchange string"


def bars(spark, *rows):
    return spark.createDataFrame(list(rows), BARS)


def test_candidates_carry_the_last_bar(spark):
    got = universe.candidates(bars(spark, (1, date(2024, 1, 10), 10.0, 2.0, "EQ", "NSE"), (1, date(2024, 1, 20), 20.0, None, "BE", "NSE"), (2, date(2024, 4, 2), 5.0, 1.0, None, None)))
    rows = {(r.instrument, str(r.as_of)): r for r in got.collect()}
    assert sorted(rows) == [(1, f"2024-0{m}") for m in ("1-31", "2-29", "3-31", "4-30")] + [(2, "2024-04-30")]
    first, last = rows[1, "2024-01-31"], rows[1, "2024-04-30"]
    assert (first.price, first.turnover_20, first.history, first.missed, first.series) == (20.0, 20.0, 2, 0, "BE")
    assert (last.price, last.missed) == (20.0, 1)


def test_candidates_of_no_bars(spark):
    assert universe.candidates(bars(spark)).count() == 0


def test_rules_in_order(spark):
    ok = (1, DAY, "EQ", "NSE", 100.0, 2e7, 2e7, 300, 0, False, False)
    change = lambda i, k, v: (i, *ok[1:k], v, *ok[k + 1 :])
    rows = [ok, change(2, 8, 6), change(3, 3, None), change(4, 2, "BE"), change(5, 4, 19.9), change(6, 5, None), change(7, 6, 1.0), change(8, 7, 252), change(9, 9, True), (10, *change(10, 8, 6)[1:2], "BE", *change(10, 8, 6)[3:])]
    found = spark.createDataFrame(rows, "instrument long, as_of date, series string, exchange string, price double, turnover_20 double, turnover_50 double, history int, missed int, asm boolean, gsm boolean")
    got = [r.reason for r in universe.snapshot(found).orderBy("instrument").collect()]
    assert got == [None, "STALE", "EXCHANGE", "SERIES", "PRICE", "TURNOVER_20", "TURNOVER_50", "HISTORY", "SURVEILLANCE", "STALE"]
    wide = universe.UniverseRules(series=("EQ", "BE"))
    assert {r.instrument: r.reason for r in universe.snapshot(found, wide).collect()}[4] == "TRADE_TO_TRADE"


def test_flags_count_while_valid_and_known(spark):
    found = spark.createDataFrame([(1, DAY), (2, DAY), (3, DAY)], "instrument long, as_of date")
    d = lambda n: DAY + timedelta(n)
    flags = spark.createDataFrame([(1, "ASM", d(-5), None, d(-5)), (1, "ASM", d(-9), d(-6), d(-9)), (2, "GSM", d(-5), d(5), d(1)), (3, "GSM", d(-5), d(0), d(0))], "instrument long, flag string, valid_from date, valid_to date, known_from date")
    got = {r.instrument: (r.asm, r.gsm) for r in universe.flagged(found, flags).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, True)}


def test_survivorship(spark):
    ends = spark.createDataFrame([(DAY - timedelta(1),), (DAY + timedelta(9),), (DAY + timedelta(20),)], "as_of date")
    settled = spark.createDataFrame([(DAY + timedelta(k),) for k in range(10)], "day date")
    lists = spark.createDataFrame([(f, DAY + timedelta(9)) for f in ("ASM", "GSM")], "flag string, day date")
    got = {str(r.as_of): (r.missing_days, r.status, r.reasons) for r in universe.survivorship(ends, settled, lists, look_back=10).collect()}
    assert got["2024-01-10"] == (0, "COMPLETE", "")
    assert got["2024-01-21"] == (10, "PARTIAL", "10 days without a price file; ASM not collected; GSM not collected")
    assert got["2023-12-31"] == (None, "PARTIAL", "no price files; ASM starts 2024-01-10; GSM starts 2024-01-10")
    none = universe.survivorship(ends, settled.limit(0), lists.limit(0), look_back=10, delistings=False).collect()
    assert {(r.missing_days, r.status, r.reasons) for r in none} == {(None, "BIASED", "current listings only")}


def test_factor_sets_are_replaced_whole(spark):
    f = lambda *rows: spark.createDataFrame(list(rows), "instrument long, ex_date date, num int, den int")
    d = DAY + timedelta(9)
    got = adjust.replace_sets(f((1, DAY, 2, 1), (1, d, 3, 2), (2, DAY, 2, 1), (3, DAY, 2, 1)), f((1, DAY, 2, 1), (1, d, 3, 1), (2, DAY, 2, 1), (2, DAY, 2, 1), (4, DAY, 5, 1)))
    assert sorted((r.instrument, r.num, r.den, r.state) for r in got.collect()) == [(1, 2, 1, "CLOSED"), (1, 2, 1, "OPENED"), (1, 3, 1, "OPENED"), (1, 3, 2, "CLOSED"), (2, 2, 1, "KEPT"), (3, 2, 1, "CLOSED"), (4, 5, 1, "OPENED")]


def test_long_uptrend_reads_days_before_only(spark):
    days = spark.createDataFrame([(DAY + timedelta(k), on) for k, on in enumerate((True, True, True, False, True))], "trade_date date, index_on boolean")
    got = [r.long_uptrend for r in market.long_uptrend(days, run=2).orderBy("trade_date").collect()]
    assert got == [False, False, True, True, False]
