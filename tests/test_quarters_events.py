"""Quarters, events, price days and scores by hand-made frames."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from barloom.functions import ladder
from barloom.operators import events, quarters, scores
from barloom.sources import files

D = date


def snapshots(spark, *rows):
    """(period_end, basis, revision, available_at, status, revenue, eps) of entity 1; margins' parts follow revenue."""
    data = [(1, p, b, r, a, s, v, e, v and v / 10, v and v * 0.2, v and v * 0.01, v and v * 0.02, v and v * 0.03, False) for p, b, r, a, s, v, e in rows]
    return spark.createDataFrame(data, "entity long, period_end date, basis string, revision int, available_at date, status string, revenue double, eps double, net_profit double, pbt double, finance_costs double, depreciation double, other_income double, is_financial boolean")


def actions(spark, *rows):
    return spark.createDataFrame([(1, d, f) for d, f in rows], "entity long, ex_date date, factor double")


def test_quarters_as_known_at_a_day(spark):
    rows = [
        (D(2019, 3, 31), "CONSOLIDATED", 0, D(2019, 5, 1), "OK", 100.0, 10.0), (D(2019, 6, 30), "STANDALONE", 0, D(2019, 8, 1), "OK", 100.0, 10.0), (D(2019, 9, 30), "CONSOLIDATED", 0, D(2019, 11, 1), "OK", 100.0, -1.0), (D(2020, 3, 31), "CONSOLIDATED", 0, D(2020, 5, 1), "OK", 150.0, 6.0),
        (D(2020, 3, 31), "CONSOLIDATED", 1, D(2020, 6, 1), "OK", 160.0, 7.0), (D(2020, 3, 31), "CONSOLIDATED", 2, D(2020, 7, 1), "INVALID", 1.0, 1.0), (D(2020, 3, 31), "CONSOLIDATED", 3, D(2021, 7, 1), "OK", 2.0, 2.0), (D(2020, 6, 30), "CONSOLIDATED", 0, D(2020, 8, 1), "OK", 120.0, 8.0),
        (D(2020, 9, 30), "CONSOLIDATED", 0, D(2020, 11, 1), "OK", None, 4.0), (D(2020, 9, 30), "STANDALONE", 0, D(2020, 11, 1), "OK", 90.0, 3.0),
    ]
    snaps, acts = snapshots(spark, *rows), actions(spark, (D(2020, 1, 15), 0.5), (D(2020, 1, 15), 0.5), (D(2021, 1, 1), 0.1))
    got = {r.period_end: r for r in quarters.quarter_history(snaps, acts, "2020-12-31").collect()}
    assert {r.basis for r in got.values()} == {"CONSOLIDATED"} and set(got) == {D(2019, 3, 31), D(2019, 9, 30), D(2020, 3, 31), D(2020, 6, 30), D(2020, 9, 30)}
    march = got[D(2020, 3, 31)]
    # Two actions of one day quarter the earnings filed before; one behind the cutoff does nothing.
    assert (march.revision, march.eps, got[D(2019, 3, 31)].eps, got[D(2019, 3, 31)].eps_as_filed) == (1, 7.0, 2.5, 10.0)
    assert march.eps_yoy == pytest.approx(180.0) and march.sales_yoy == pytest.approx(60.0) and march.net_margin == pytest.approx(10.0) and march.operating_margin == pytest.approx(20.0)
    assert got[D(2020, 6, 30)].eps_yoy_state == "BASIS_CHANGE" and got[D(2020, 9, 30)].eps_yoy_state == "NEGATIVE_BASE" and got[D(2020, 9, 30)].sales_yoy_state == "MISSING" and got[D(2020, 9, 30)].net_margin is None and got[D(2019, 3, 31)].eps_yoy_state == "MISSING"
    view = quarters.current_views(quarters.quarter_history(snaps, acts, "2020-12-31"), "2020-12-31")
    assert view.first().period_end == D(2020, 9, 30) and not view.first().stale and quarters.current_views(quarters.quarter_history(snaps, acts, "2020-12-31"), "2021-12-31").first().stale
    assert quarters.screened_views(view, min_eps_yoy=-1e9).count() == 0 and quarters.screened_views(view).count() == 1
    assert quarters.quarter_history(snaps.limit(0), acts, "2020-12-31").count() == 0
    assert quarters.quarter_history(snaps, acts.limit(0), "2019-12-31", limit=1).first().period_end == D(2019, 9, 30)


def readings(spark, *rows):
    return spark.createDataFrame([(i, D(2020, 1, d), k, n, m, s, st) for i, d, k, n, m, s, st in rows], "instrument long, ex_date date, kind string, num double, den double, state string, status string")


def test_one_cause_an_action(spark):
    got = events.action_events(readings(
        spark, (1, 1, "SPLIT", None, None, "UNKNOWN", "CONFIRMED"), (2, 1, "RIGHTS", 1.0, 2.0, "UNKNOWN", "PROVIDER_CONFLICT"), (3, 1, "SPLIT", 2.0, 1.0, "UNCONFIRMED", "CONFIRMED"), (3, 1, "BONUS", 1.0, 1.0, "UNCONFIRMED", "CONFIRMED"),
        (4, 1, "SPLIT", 2.0, 1.0, "UNCONFIRMED", "MANUAL_OVERRIDE"), (5, 1, "SPLIT", 2.0, 1.0, "APPLIED", "PROVIDER_CONFLICT"), (6, 1, "DEMERGER", None, None, "APPLIED", "PROVIDER_CONFLICT"), (7, 1, "BONUS", 1.0, 1.0, "SUPERSEDED", "PROVIDER_CONFLICT"),
        (7, 1, "UNMODELLED", None, None, "UNMODELLED", None), (8, 1, "SPLIT", 2.0, 1.0, "APPLIED", None),
    ))
    assert sorted((r.instrument, r.cause, r.severity, r.blocks) for r in got.collect()) == [
        (1, "RATIO_UNKNOWN", "CRITICAL", True), (2, "FACTOR_UNKNOWN", "CRITICAL", True), (3, "RATIO_UNCONFIRMED", "CRITICAL", True), (5, "CONFLICT", "CRITICAL", True), (6, "CONFLICT", "WARNING", False), (7, "UNMODELLED", "WARNING", False),
    ]
    assert got.select("event_id").distinct().count() == 6
    soft = events.action_events(readings(spark, (5, 1, "SPLIT", 2.0, 1.0, "APPLIED", "PROVIDER_CONFLICT")), conflict_blocks=False).first()
    assert soft.severity == "CRITICAL" and not soft.blocks
    page = events.event_page(got, 2, severity="critical")
    assert page.count() == 2 and {r.total for r in page.collect()} == {4} and events.event_page(got, 9, instrument=7).count() == 1


def test_code_changes_near_a_split(spark):
    codes = spark.createDataFrame([(i, D(2020, 1, d), c) for i in (1, 2, 3, 4) for d, c in ((5, "a"), (6, None), (15, "b"), (16, "b"))], "instrument long, trade_date date, code string")
    splits = spark.createDataFrame([(1, D(2020, 1, 8)), (2, D(2020, 1, 16)), (3, D(2020, 1, 7)), (4, D(2020, 1, 17))], "instrument long, ex_date date")
    assert sorted((r.instrument, r.trade_date, r.note) for r in events.identity_events(codes, splits).collect()) == [(3, D(2020, 1, 15), "a to b"), (4, D(2020, 1, 15), "a to b")]


def test_price_files_are_refused_whole(spark):
    old, new = ",".join(files.OLD[:9]), ",".join(files.NEW[:9])
    row = lambda symbol, isin, day, series="EQ", close="10", high="11": f"{symbol},{series},{isin},10,{high},9,{close},5,{day}"
    lines = [
        (D(2020, 1, 1), old), (D(2020, 1, 1), row("A", "INE1", "01-Jan-2020")), (D(2020, 1, 1), row("F", "INF1", "01-Jan-2020")), (D(2020, 1, 1), row("B", "INE2", "01-Jan-2020", "XX")), (D(2020, 1, 1), row("C", "INE3", "01-Jan-2020", high="-")), (D(2020, 1, 1), row("A", "INE1", "01-Jan-2020")), (D(2020, 1, 1), ""),
        (D(2020, 1, 2), old), (D(2020, 1, 2), row("A", "INE1", "02-Jan-2020")), (D(2020, 1, 2), row("B", "INE1", "03-Jan-2020")), (D(2020, 1, 3), new), (D(2020, 1, 3), row("A", "INE1", "2020-01-03")), (D(2020, 1, 4), old), (D(2020, 1, 4), row("A", "INE1", "2020-01-04")), (None, new),
    ]
    good, bad, days = files.price_days(spark.createDataFrame(lines, "file_day date, line string"), "2020-01-03", ["EQ"])
    assert sorted((r.file_day.day, r.state, r.n_rows, r.n_rejects, r.n_skipped, r.n_units) for r in days.collect()) == [(1, "OK", 1, 2, 1, 1), (2, "WRONG_DATE", None, None, None, None), (3, "OK", 1, 0, 0, 0), (4, "BAD_HEADER", None, None, None, None)]
    assert sorted((r.file_day.day, r.symbol) for r in good.collect()) == [(1, "A"), (3, "A")] and sorted(r.reason for r in bad.collect()) == ["NO_PRICE", "REPEATED"]


def test_file_days_come_from_names(spark, tmp_path):
    for name in ("ind_2020-01-01.csv", "ind_2020-01-02.csv", "other.csv"):
        (tmp_path / name).write_text(f"{files.INDEX_HEADER}\nA,01-01-2020,10.5,-\n")
    rows, days = files.index_closes(files.file_lines(spark, f"file://{tmp_path}"))
    assert [tuple(r) for r in rows.collect()] == [("A", D(2020, 1, 1), 10.5, None)]
    assert sorted((r.file_day.day, r.state) for r in days.collect()) == [(1, "OK"), (2, "WRONG_DATE")]


def test_scores_and_ladders(spark):
    df = spark.createDataFrame([(1, 7.0, None), (2, 16.0, 13.0), (3, None, None), (4, float("nan"), 6.0), (5, 11.5, 6.0)], "k int, right_side_range_pct double, final_contraction_pct double")
    rows = df.select("*", *[F.lit(None).cast("double").alias(c) for c in list(scores.PARTS)[2:]])
    assert {r.k: r.s for r in rows.select("k", scores.score_of().alias("s")).collect()} == {1: 100.0, 2: 0.0, 3: None, 4: 100.0, 5: 75.0}
    steps = [(2, 100), (4, 60), (5, 30), (6, 0)]
    x = spark.createDataFrame([(v,) for v in (0.0, 2.0, 3.0, 4.5, 6.0, 9.0, None)], "x double")
    assert [r.y for r in x.select(ladder(F.col("x"), steps).alias("y")).collect()] == [100.0, 100.0, 80.0, 45.0, 0.0, 0.0, None]
