"""Maximal runs of positions that match a predicate (gaps and islands), without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlytics.operators.positions import BLOCK, block_of, dense_positions, few
from seqlytics.sources.scratch import written


def matching_runs(rows: DataFrame, match: Column, left: int | None = None, right: int | None = None, size: int = BLOCK) -> DataFrame:
    """(first, past): maximal half-open runs of matching positions, inside ``[left, right)`` if given.

    Runs are found within blocks of positions; those that touch a block's ends are put together over the block table only.
    """
    if left is not None:
        rows = rows.where((F.col("pos") >= left) & (F.col("pos") < right))
    hits = rows.where(match).select("pos", block_of("pos", size).alias("_b"))
    own = Window.partitionBy("_b").orderBy("pos")
    islands = hits.withColumn("_i", F.col("pos") - F.row_number().over(own)).groupBy("_b", "_i").agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("past"))
    first_in, past_in = F.col("_b") * size, (F.col("_b") + 1) * size
    edge = (F.col("first") == first_in) | (F.col("past") == past_in)
    inner = islands.where(~edge).select("first", "past")
    # At most two edge runs a block are left.
    edges = written(islands.where(edge).select("first", "past"), "edges")
    if few(edges):
        w = Window.orderBy("first")
        starts = F.when(F.lag("past").over(w) == F.col("first"), 0).otherwise(1)
        joined = edges.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(w)).groupBy("_g").agg(F.min("first").alias("first"), F.max("past").alias("past")).drop("_g")
    else:  # the k-th start that follows no edge run belongs to the k-th end that none follows
        starts = edges.join(edges.select(F.col("past").alias("first")), "first", "left_anti").select("first")
        ends = edges.join(edges.select(F.col("first").alias("past")), "past", "left_anti").select("past")
        joined = dense_positions(starts, ("first",), "_k").join(dense_positions(ends, ("past",), "_k"), "_k").drop("_k")
    return inner.unionByName(joined).select(F.col("first").cast("long"), F.col("past").cast("long"))
