"""Queries of XML filings: results and shareholdings are written as documents from the given tables, landed, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import streaming as st
from barloom.functions import r6
from barloom.plans.fundamentals import latest, shares
from barloom.plans.sql import with_
from barloom.sources import filings, store


def landed(s, docs):
    """Documents in a folder of the shared place, read back."""
    path = f"{st.scratch(s)}/filings"
    with store.released(s):
        docs.write.option("compression", "zstd").parquet(path)
    return s.read.parquet(path)


def element(tag, context, value):
    return F.concat(F.lit(f'<r:{tag} contextRef="{context}" decimals="0">'), value.cast("string"), F.lit(f"</r:{tag}>"))


def context(name, start, end):
    return F.concat(F.lit(f'<x:context id="{name}"><x:period><x:startDate>'), start.cast("string"), F.lit("</x:startDate><x:endDate>"), end.cast("string"), F.lit("</x:endDate></x:period></x:context>"))


def results(s, d):
    """A filing for each customer and quarter with orders. By customer: broken off, without period, of a bank, with owners left at 0, or plain; all but first quarters with the year to date."""
    kind, start, end = F.col("entity") % 7, F.col("period"), F.last_day(F.add_months("period", 2))
    v, none = F.col("value"), F.lit("")
    ytd, year = F.quarter("period") > 1, F.trunc("period", "year")
    income = lambda c, x: F.when(kind == 2, F.concat(element("Income", c, x), element("InterestEarned", c, x / 2))).otherwise(element("RevenueFromOperations", c, x))
    eps = F.concat(F.when(kind != 3, element("BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations", "OneD", F.lit(1.5))).otherwise(none), element("BasicEarningsPerShareAfterExtraordinaryItems", "OneD", F.lit(2.5)))
    owners = F.when(kind == 3, F.concat(element("ProfitOrLossAttributableToOwnersOfParent", "OneD", F.lit(0)), element("ProfitOrLossAttributableToNonControllingInterests", "OneD", v / 20))).otherwise(none)
    body = F.concat(
        F.when(kind == 1, none).otherwise(context("OneD", start, end)), F.when((kind != 1) & ytd, context("FourD", year, end)).otherwise(none), F.lit('<x:context id="Segment1"/>'), element("RevenueFromOperations", "Segment1", F.lit(7)), income("OneD", v),
        element("ProfitLossForPeriod", "OneD", v / 10), eps, owners, F.when(ytd, income("FourD", v * 2)).otherwise(none), element("Equity", "OneI", v * 3), element("BorrowingsCurrent", "OneI", v), element("BorrowingsNoncurrent", "OneI", v / 2),
        element("NatureOfReportStandaloneConsolidated", "OneD", F.lit("Consolidated")), element("DescriptionOfPresentationCurrency", "OneD", F.lit("INR")),
    )
    text = F.concat(F.lit('<?xml version="1.0"?><x:xbrl xmlns:x="x" xmlns:r="r">'), body, F.when(kind == 0, none).otherwise(F.lit("</x:xbrl>")))
    return landed(s, latest(s, d).select(F.concat_ws(":", "entity", "period").alias("doc"), text.alias("content")))


def holdings(s, d):
    """A filing for each supplier and quarter: parts A, B and C as promoter, public and others; by supplier as fractions or percent, without public line, or one part short."""
    kind = F.col("entity") % 5
    unit = F.when(kind == 0, 100.0).otherwise(1.0)
    wide = shares(s, d).groupBy("entity", "period").pivot("part", ["A", "B", "C"]).agg(F.first("pct"))
    tag = "ShareholdingAsAPercentageOfTotalNumberOfShares"
    line = lambda c, name, skip=F.lit(False): F.when(F.col(c).isNull() | skip, F.lit("")).otherwise(element(tag, name, F.col(c) / unit))
    body = F.concat(line("A", "ShareholdingOfPromoterAndPromoterGroup_ContextI"), line("B", "PublicShareholding_ContextI", kind == 1), line("C", "SharesHeldByNonPromoterNonPublicShareholders_ContextI", kind == 2), line("B", "MutualFundsOrUtiI"))
    text = F.concat(F.lit('<x:xbrl xmlns:x="x" xmlns:r="r">'), body, F.lit("</x:xbrl>"))
    return landed(s, wide.select(F.concat_ws(":", "entity", "period").alias("doc"), text.alias("content")))


def read_once(s, docs):
    """The facts of documents, which headers, items and rejects read several times: parsed once and landed."""
    path = f"{st.scratch(s)}/facts"
    filings.xml_facts(docs).write.option("compression", "zstd").parquet(path)
    return s.read.parquet(path)


def read_results(s, d, part):
    return filings.result_filings(read_once(s, results(s, d)))[part]


QUERIES = {
    "src10_headers": lambda s, d: read_results(s, d, 0),
    "src10_items": lambda s, d: read_results(s, d, 1).withColumn("value", r6(F.col("value"))),
    "src10_rejects": lambda s, d: read_results(s, d, 2),
    "src11_holdings": lambda s, d: filings.shareholdings(read_once(s, holdings(s, d)))[0].select("doc", "scale", *[r6(F.col(c)).alias(c) for c in ("promoter_pct", "public_pct", "other_pct", "funds_pct")]),
    "src11_rejects": lambda s, d: filings.shareholdings(read_once(s, holdings(s, d)))[1],
}

_LATEST = """o AS (SELECT o_custkey AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, o_totalprice, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders),
r AS (SELECT entity, period, round(sum(o_totalprice) OVER (PARTITION BY entity, period ORDER BY day, o_orderkey) + 3e-5, 2) AS v, row_number() OVER (PARTITION BY entity, period ORDER BY day DESC, o_orderkey DESC) AS k FROM o),
f AS (SELECT entity, period, entity || ':' || period AS doc, entity % 7 AS kind, v, quarter(period) > 1 AS ytd FROM r WHERE k = 1)"""
_HELD = """l AS (SELECT l_suppkey AS entity, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, CASE l_returnflag WHEN 'N' THEN 'A' WHEN 'A' THEN 'B' ELSE 'C' END AS part, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT entity, period, part, round(q / sum(q) OVER (PARTITION BY entity, period) * 100 + 3e-7, 4) AS pct FROM l),
w AS (SELECT entity || ':' || period AS doc, entity % 5 AS kind, max(pct) FILTER (WHERE part = 'A') AS a, CASE WHEN entity % 5 <> 1 THEN max(pct) FILTER (WHERE part = 'B') END AS b, max(pct) FILTER (WHERE part = 'B') AS funds, CASE WHEN entity % 5 <> 2 THEN max(pct) FILTER (WHERE part = 'C') END AS c FROM p GROUP BY entity, period),
x AS (SELECT *, coalesce(a, 0) + b + coalesce(c, 0) AS parts, 100 - coalesce(a, 0) - b AS gap, coalesce(c, 0) <> 0 AS held FROM w),
j AS (SELECT *, CASE WHEN b IS NULL THEN 'no public line' WHEN abs(parts - 100) >= 2 THEN 'parts are neither 1 nor 100' WHEN gap < -0.6 OR (gap > 0.6 AND NOT held) THEN 'parts do not sum to 100' END AS reason FROM x)"""

ORACLES = {
    "src10_headers": with_(_LATEST) + """SELECT doc, 'CONSOLIDATED' AS basis, 'INR' AS currency, period AS starts, CAST(period + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS ends, CASE WHEN ytd THEN CAST(date_trunc('year', period) AS DATE) END AS ytd_starts,
  CASE WHEN ytd THEN CAST(period + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) END AS ytd_ends, 'QUARTER' AS period_type, kind = 2 AS is_financial FROM f WHERE kind > 1""",
    "src10_items": with_(_LATEST) + """, i AS (SELECT doc, 'PERIOD' AS scope, 'revenue' AS item, v AS value FROM f WHERE kind > 1 UNION ALL SELECT doc, 'PERIOD', 'net_profit', v / 10 FROM f WHERE kind > 1 UNION ALL SELECT doc, 'PERIOD', 'eps', CASE WHEN kind = 3 THEN 2.5 ELSE 1.5 END FROM f WHERE kind > 1
  UNION ALL SELECT doc, 'PERIOD', 'profit_owners', v / 10 - v / 20 FROM f WHERE kind = 3 UNION ALL SELECT doc, 'YTD', 'revenue', v * 2 FROM f WHERE kind > 1 AND ytd UNION ALL SELECT doc, 'INSTANT', 'equity', v * 3 FROM f WHERE kind > 1 UNION ALL SELECT doc, 'INSTANT', 'borrowings', v * 1.5 FROM f WHERE kind > 1)
SELECT doc, scope, item, round(value + 3e-10, 6) AS value FROM i""",
    "src10_rejects": with_(_LATEST) + "SELECT doc, CASE kind WHEN 0 THEN 'not XML' ELSE 'no reporting period' END AS reason FROM f WHERE kind < 2",
    "src11_holdings": with_(_HELD) + """SELECT doc, CASE WHEN kind = 0 THEN 100.0 ELSE 1.0 END AS scale, round(coalesce(a, 0) + 3e-10, 6) AS promoter_pct, round(b + 3e-10, 6) AS public_pct, round(CASE WHEN greatest(gap, 0) <= 0.6 AND NOT held THEN 0.0 ELSE greatest(gap, 0) END + 3e-10, 6) AS other_pct,
  round(coalesce(funds, 0) + 3e-10, 6) AS funds_pct FROM j WHERE reason IS NULL""",
    "src11_rejects": with_(_HELD) + "SELECT doc, reason FROM j WHERE reason IS NOT NULL",
}
