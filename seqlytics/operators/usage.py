"""Bytes that compact representations of given tables would take: counts by distributed aggregation, then the formulas of ``storage``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlytics.operators import storage, suffix, trie
from seqlytics.sources.scratch import written

#: Shifts of the four-symbol levels of the 9-bit table, below its first bit.
NINE_BIT_SHIFTS = (6, 4, 2, 0)


def level_symbol_counts(rows: DataFrame, shifts: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """For each shift how often each base-4 digit occurs there in (pos, value), in one pass."""
    if not shifts:
        return []
    digit = {k: F.shiftrightunsigned(F.col("value").cast("long"), k).bitwiseAND(F.lit(3)) for k in shifts}
    found = rows.agg(*[F.count_if(digit[k] == s) for k in shifts for s in range(4)]).first()
    return [tuple(found[4 * i : 4 * i + 4]) for i in range(len(shifts))]


def quad_table_bytes(rows: DataFrame, width: int) -> dict[str, int]:
    """Payload, auxiliary and allocated bytes of all base-4 levels of a table of ``width`` bits, values below 2**63."""
    return storage.levels_bytes(level_symbol_counts(rows, tuple(range(0, width, 2))))


def nine_bit_bytes(rows: DataFrame) -> int:
    n = rows.count()
    return storage.hybrid_actual_bytes(n, level_symbol_counts(rows, NINE_BIT_SHIFTS) if n else [])


def trie_usage(nodes: DataFrame, strings: int) -> dict[str, int]:
    """Bytes of the parts of a trie's node table of so many strings."""
    edge, behind = F.col("parent").isNotNull(), F.col("label_bytes") - 1
    counts = nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(edge).alias("edges"), F.count_if(F.col("terminal_id").isNotNull()).alias("terminals"), F.count_if(F.col("children") > 0).alias("inner"),
        F.count_if(F.col("children") >= trie.HIGH_DEGREE).alias("high"), F.max("children").alias("most_children"), F.coalesce(F.sum(F.when(edge, behind)), F.lit(0)).alias("suffix_bytes"), F.count_if(edge & (behind > 0)).alias("suffix_edges"),
    ).first()
    words = trie.parent_widths(nodes).agg(F.sum("words")).first()[0]
    return storage.trie_bytes(counts.asDict(), words, strings)


def dictionary_usage(strings: DataFrame) -> dict[str, int]:
    """Bytes of the parts of a dictionary (id, s): the trie and the text index, whose symbols and runs are counted."""
    n = strings.count()
    transformed = written(suffix.bwt(text := written(suffix.text_symbols(strings), "text"), suffix.suffix_array(text)), "bwt")
    values = transformed.select(F.col("row").alias("pos"), F.col("sym").alias("value"))
    symbols, runs = transformed.count(), suffix.symbol_runs(values.withColumnRenamed("value", "sym")).count()
    total = trie_usage(written(trie.trie_nodes(strings), "nodes"), n)["total"]
    return storage.dictionary_bytes(total, n, symbols, runs, level_symbol_counts(values, NINE_BIT_SHIFTS))
