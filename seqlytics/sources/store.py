"""Persisted tables: Parquet with a one-row description beside it, so that derived columns are not computed again when reopened."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, **about: Any) -> None:
    """Writes ``df`` and its description. Both are written by Spark, so any file system that Spark knows will do."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, Any]]:
    """The table and its description; ValueError if one of ``columns`` is missing."""
    df = spark.read.parquet(f"{path}/rows")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df, json.loads(spark.read.schema("about string").json(f"{path}/about").first()[0])


def reopen(spark: SparkSession, path: str, kind: str, width: int | None = None, position: str = "pos") -> tuple[DataFrame, dict[str, Any]]:
    """A table that was saved with its ``kind`` (and ``width`` and number of rows ``n``); ValueError if it is of another, or is not what it was saved as."""
    df, about = load(spark, path, (position,))
    if about.get("kind") != kind:
        raise ValueError(f"a {about.get('kind')} table, not a {kind} one")
    if width is not None and about.get("width") != width:
        raise ValueError(f"{about.get('width')} bits, not {width}")
    n, low, high = df.agg(F.count(F.lit(1)), F.min(position), F.max(position)).first()
    if n != about.get("n", n):
        raise ValueError(f"{n} rows of {about['n']}")
    if n and (low != 0 or high != n - 1):
        raise ValueError("positions must be dense and start at 0")
    return df, about
