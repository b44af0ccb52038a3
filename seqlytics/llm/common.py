"""Shared plumbing of the corpus operators: Arrow helpers and byte hashing; scratch tables are the package's own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlytics.sources.scratch import discard, scratch_path, shared_dir, table, written

__all__ = ["as_bytes", "batch", "bounded_batches", "discard", "each", "hashed_sample", "mix64", "most_frequent", "pick", "scratch_path", "shared_dir", "table", "written"]

def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Arrow batches by bytes as well as rows, so that very long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them in between."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return column.to_pylist()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def batch(schema: pa.Schema, **columns: Any) -> pa.RecordBatch:
    """A record batch with the columns in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def each(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[pa.Array]]:
    """The named columns of every batch that has rows."""
    for b in batches:
        if b.num_rows:
            yield [b.column(b.schema.get_field_index(n)) for n in names]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator needs, so that extra columns never clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``counts`` with the largest ``column``: whole classes of 1/64 of a natural logarithm, so no task sends more rows than it has in them.

    A sorted limit would send ``most`` rows from every task to the driver.
    """
    bins = F.floor(F.log(F.col(column).cast("double")) * 64)
    sizes = counts.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each class, under 3,000
    held, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["bin"]):
        held += r["n"]
        if held > most:
            break
        least = r["bin"]
    return counts.where(bins >= least) if least is not None else counts.limit(0)


def hashed_sample(df: DataFrame, key: tuple[str, ...], most: int, seed: int) -> DataFrame:
    """About 0.9 * ``most`` rows of ``df``, or all if there are no more than that: those whose key's hash is below a bound."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) < int(0.9 * most / n * (1 << 30)))
