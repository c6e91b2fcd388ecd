"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import drift_queries, reference_oracles, reference_queries, roundtrip_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**reference_queries.QUERIES, **drift_queries.QUERIES, **roundtrip_queries.QUERIES}
ORACLES: dict[str, str] = {**reference_oracles.ORACLES, **drift_queries.ORACLES, **roundtrip_queries.ORACLES}
