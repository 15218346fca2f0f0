"""Queries over all of their tables, not a part that stays small as the tables grow."""

from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, identity
from barloom.plans.registry import ORACLES, QUERIES
from barloom.sources.bars import model_bars

DIR = "/root/testdata/sf0.01"


def test_identities_of_all_customers(spark):
    got = QUERIES["bt09_identity"](spark, DIR).select("code", "valid_from").collect()
    want = duckdb.sql(f"SELECT 'ISS' || printf('%06d', o_custkey) || '-' || CAST(floor(year(o_orderdate) / 2) AS INTEGER), CAST(min(o_orderdate) AS DATE) FROM '{DIR}/orders.parquet' GROUP BY o_custkey, CAST(floor(year(o_orderdate) / 2) AS INTEGER)").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def code_days(spark, *runs):
    """Runs of (code, symbol, first, last) as one row a day."""
    rows = [(c, s, date(2020, 1, 1) + timedelta(k)) for c, s, first, last in runs for k in range(first, last + 1)]
    return spark.createDataFrame(rows, "code string, symbol string, day date")


def ids(links):
    return {r.code: r.id for r in identity.resolve(links).collect()}


def test_a_chain_of_forty_codes_is_one(spark):
    runs = [(f"INE000A01{k:02d}1", "X", 2 * k, 2 * k + 1) for k in range(40)]
    got = ids(identity.identifier_links(code_days(spark, *runs)))
    assert len(got) == 40 and set(got.values()) == {"INE000A01001"}


def test_all_predecessors_are_linked(spark):
    got = ids(spark.createDataFrame([("c1", "c3"), ("c2", "c3"), ("c0", "c2"), ("d1", "d2")], "a string, b string"))
    assert got == {**dict.fromkeys(["c0", "c1", "c2", "c3"], "c0"), "d1": "d1", "d2": "d1"}
    assert ids(spark.createDataFrame([("c99", "c100"), ("c100", "c101")], "a string, b string")) == dict.fromkeys(["c99", "c100", "c101"], "c99")


def test_a_renamed_symbol_continues_the_serial(spark):
    old, new, later = "INE000A01011", "INE000A01029", "INE000A01037"
    links = lambda *runs: {tuple(r) for r in identity.identifier_links(code_days(spark, *runs)).collect()}
    assert links((old, "X", 0, 3), (new, "Y", 4, 6), (later, "Z", 7, 9)) == {(old, new), (new, later)}
    assert links((old, "X", 0, 5), (new, "Y", 4, 6)) == set()  # X trades beside it
    assert links((new, "X", 0, 3), (old, "Y", 4, 6)) == set()  # a lower serial
    assert links((old, "X", 0, 3), (new, "V", 0, 3), (later, "Y", 4, 6)) == set()  # two could be it
    assert links((old, "X", 0, 3), ("INE999B01011", "X", 4, 6), (new, "Y", 4, 6)) == set()  # another issuer trades as X


def test_every_bar_has_its_row_of_facts(spark):
    got = QUERIES["dom69_facts_of_day"](spark, DIR)
    bars = model_bars(spark, DIR).selectExpr("instrument AS entity", "trade_date")
    assert got.select("entity", "trade_date").exceptAll(bars).isEmpty() and bars.exceptAll(got.select("entity", "trade_date")).isEmpty()
    assert not got.where("entity < 40 AND value IS NOT NULL").isEmpty() and not got.where("entity >= 40 AND value IS NOT NULL").isEmpty()
    first = duckdb.sql(f"SELECT o_custkey, CAST(min(o_orderdate) AS DATE) FROM '{DIR}/orders.parquet' GROUP BY 1").fetchall()
    first = spark.createDataFrame(first, "entity long, first date")
    assert got.where("value IS NULL").join(first, "entity").where("first <= trade_date").isEmpty()


def test_a_portfolio_gets_no_more_trades_of_a_day_than_slots(spark):
    day = lambda k: date(2020, 1, 1) + timedelta(k)
    bars = spark.createDataFrame([(i, day(k), 100.0 + i + k) for i in range(40) for k in range(12)], "instrument long, trade_date date, close double")
    # 40 trades enter on each of three days; the last one of the market is the longest, so that it alone is held at the end.
    rows = [("r", i, day(e), day(e + 2 + (i + e) % 3 + 4 * (i == 39 and e == 3)), 100.0 + i + e, 103.0 + i + e, "STOP", [None, float("nan"), 1.0, 2.0, 2.0][i % 5]) for e in (0, 2, 3) for i in range(40)]
    trades = spark.createDataFrame(rows, "rule string, instrument long, entry_date date, exit_date date, entry double, exit double, exit_kind string, score double")
    some = backtest.contenders(trades, bars, 3).groupBy("entry_date").agg(F.sort_array(F.collect_list("instrument")).alias("i")).collect()
    assert {r.entry_date: r.i for r in some} == {day(e): [3, 4, 8] for e in (0, 2, 3)}
    got = {r.day: r for r in backtest.portfolio(trades, bars, 3).collect()}
    every = {r.day: r for r in backtest.portfolio(trades, bars, 40).collect()}
    assert sorted(got) == sorted(every) == sorted({day(k) for t in rows for k in range(12) if t[2] <= day(k) <= t[3]})
    # Against a plain fold over all trades.
    cash, shares, key = 1.0, {}, lambda t: (-(t[7] if t[7] is not None and t[7] == t[7] else -1), t[1])
    for d in sorted(got):
        k, taken = (d - day(0)).days, 0
        for t in [t for t in shares if t[3] == d]:
            cash += shares.pop(t) * t[5] * 0.9985
        value = cash + sum(n * (100 + t[1] + k) for t, n in shares.items())
        for t in sorted((t for t in rows if t[2] == d), key=key):
            if len(shares) < 3 and (size := min(value / 3, cash)) > 0:
                shares[t], cash, taken = size / (t[4] * 1.0015), cash - size, taken + 1
        assert (got[d].n_open, got[d].n_taken) == (len(shares), taken)
        assert got[d].cash == pytest.approx(cash) and got[d].value == pytest.approx(cash + sum(n * (100 + t[1] + k) for t, n in shares.items()))


@pytest.mark.parametrize("name", ["src01_day_rows", "src01_price_files"])
def test_keys_of_seven_digits(spark, tmp_path, name):
    duck = duckdb.connect()
    duck.sql(f"COPY (SELECT * REPLACE (l_partkey + 1_190_000 AS l_partkey) FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = duck.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", ["src10_headers", "src10_rejects"])
def test_filings_are_parsed_once(spark, capsys, name):
    capsys.readouterr()
    QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "MapInArrow" not in plan
