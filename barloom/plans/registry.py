"""All queries of the screening engine by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.plans import files, filings, fundamentals, market, quality, records, reports, research, screen, streams, studies, temporal, universe

PARTS = (screen, temporal, market, studies, research, fundamentals, streams, files, quality, reports, universe, filings, records)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in PARTS for k, v in p.ORACLES.items()}
