"""String dictionaries (id, s): search by bytes. Ids are answered in ascending order; matches never cross strings.

Patterns that are valid UTF-8 are also looked for as strings, which Parquet scans can push down; the answer is the same, because UTF-8
occurrences of such patterns begin and end at characters. Pass a BINARY column for arbitrary bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlytics.operators import suffix, usage
from seqlytics.sources.scratch import written


def as_binary(c: Column) -> Column:
    return c.cast("binary")


def occurrences_of(b: Column, pattern: Column) -> Column:
    """How often ``pattern`` occurs in ``b``, overlaps included; byte length plus one for an empty pattern. Only offsets where it could start are tried."""
    last = F.octet_length(b) - F.octet_length(pattern)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1))), lambda i: F.substring(b, i, F.octet_length(pattern)) == pattern)
    return F.when(last < 0, F.lit(0)).otherwise(F.size(starts)).cast("long")


class TextDictionary:
    """Distinct strings with ids. With ``distinct=False`` duplicates are allowed: exact search and prefixes in trie order give the smallest id."""

    def __init__(self, rows: DataFrame, distinct: bool = True) -> None:
        self.rows = rows.select("id", "s")
        self.binary = dict(self.rows.dtypes)["s"] == "binary"
        if distinct and duplicates(self.rows).limit(1).count():
            raise ValueError("strings must be distinct")

    def _matching(self, pattern: bytes | str, how: str) -> DataFrame:
        raw = pattern.encode() if isinstance(pattern, str) else bytes(pattern)
        if not raw:
            return self.rows
        if not self.binary:
            try:
                return self.rows.where(getattr(F.col("s"), how)(raw.decode()))
            except UnicodeDecodeError:
                pass
        b, p = as_binary(F.col("s")), F.lit(bytearray(raw))
        test = {"startswith": F.startswith, "endswith": F.endswith, "contains": F.contains}[how]
        return self.rows.where(test(b, p))

    def find_exact(self, pattern: bytes | str) -> int | None:
        raw = pattern.encode() if isinstance(pattern, str) else bytes(pattern)
        return self.rows.where(as_binary(F.col("s")) == F.lit(bytearray(raw))).agg(F.min("id")).first()[0]

    def find_exact_batch(self, queries: DataFrame) -> DataFrame:
        """``queries`` (with s) with the smallest id of the equal string, or null. Strings meet by their bytes."""
        own = self.rows.groupBy(as_binary(F.col("s")).alias("_b")).agg(F.min("id").alias("id"))
        return queries.withColumn("_b", as_binary(F.col("s"))).join(own, "_b", "left").drop("_b")

    def find_exact_fm(self, pattern: bytes | str) -> int | None:
        """Of equal strings the one whose text comes first with all that follows it: the strings behind it, in the order of ids, from 0 without gaps."""
        raw = pattern.encode() if isinstance(pattern, str) else bytes(pattern)
        same = self.rows.where(as_binary(F.col("s")) == F.lit(bytearray(raw))).select("id")
        if same.count() < 2:
            return self.find_exact(pattern)
        text = written(suffix.text_symbols(self.rows), "text")
        starts = text.where(F.col("sym") == suffix.SEPARATOR).join(same, "id").select("pos", "id")
        return suffix.suffix_array(text).join(starts, "pos").agg(F.min_by("id", "row")).first()[0]

    def memory_usage(self) -> dict[str, int]:
        """Bytes that the parts of a compact dictionary of these strings would take."""
        return usage.dictionary_usage(self.rows)

    def contains(self, pattern: bytes | str) -> bool:
        return self.find_exact(pattern) is not None

    def find_prefix(self, pattern: bytes | str) -> DataFrame:
        return self._matching(pattern, "startswith").select("id").orderBy("id")

    def find_prefix_trie_order(self, pattern: bytes | str) -> DataFrame:
        """In the byte order of the strings."""
        found = self._matching(pattern, "startswith").groupBy("s").agg(F.min("id").alias("id"))
        return found.orderBy(as_binary(F.col("s"))).select("id")

    def find_suffix(self, pattern: bytes | str) -> DataFrame:
        return self._matching(pattern, "endswith").select("id").orderBy("id")

    def find_substring(self, pattern: bytes | str) -> DataFrame:
        return self._matching(pattern, "contains").select("id").orderBy("id")

    def find_substring_occurrences(self, pattern: bytes | str) -> DataFrame:
        """(id, occurrences)."""
        raw = pattern.encode() if isinstance(pattern, str) else bytes(pattern)
        n = occurrences_of(as_binary(F.col("s")), F.lit(bytearray(raw))) if raw else (F.octet_length("s") + 1).cast("long")
        return self._matching(pattern, "contains").select("id", n.alias("occurrences")).orderBy("id")

    def restore(self, i: int) -> str | bytes:
        hit = self.rows.where(F.col("id") == i).first()
        if hit is None:
            raise IndexError(f"there is no string {i}")
        return hit["s"]

    def __len__(self) -> int:
        return self.rows.count()

    def items(self) -> Iterator[str | bytes]:
        """All strings in the order of their ids, fetched as they are asked for."""
        return (r["s"] for r in self.rows.orderBy("id").toLocalIterator())


def duplicates(rows: DataFrame) -> DataFrame:
    """(s, n, first_id) of strings that occur more than once."""
    return rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")
