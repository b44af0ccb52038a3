"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqlytics.plans import columns, sequences, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = sequences.QUERIES | columns.QUERIES | texts.QUERIES
ORACLES: dict[str, str] = sequences.ORACLES | columns.ORACLES | texts.ORACLES
