"""Batches of questions on ranges of positions and values, (pos, value) with BIGINT values: each row and each question goes to a few groups, and a group is answered by a wavelet matrix in one task's memory.

Counts: a range is answered by the blocks that hold its ends, and, for the blocks between, by the chunk of values that holds the bound and a table of counts by chunk and block.
So every row goes to one block and, summed by value and block, to one chunk; a question goes to two blocks and a chunk for each bound.
Short ranges lie in one window of blocks that overlap, which also knows their k-th smallest value, predecessor and successor.
Groups that many ask are given to several tasks, each with a part of the questions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqlytics.sources.scratch import written

#: Positions of a block, and rows of a chunk, at least; blocks and chunks at most, so that the table of counts has 8 MB.
SIDE, MOST = 1 << 17, 1 << 10
#: Questions of a group that one task answers.
SHARE = 1 << 18
#: The longest range that a window holds wherever it starts.
NEAR = 1 << 14


class Matrix:
    """A wavelet matrix of values in their order, for arrays of questions [l, r); with ``weights`` counts are sums of those."""

    def __init__(self, values: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.values, ranks = np.unique(values, return_inverse=True)
        self.levels = []
        for bit in range(len(self.values).bit_length() - 1, -1, -1):
            ones = (ranks >> bit) & 1 == 1
            zeros = np.zeros(len(ranks) + 1, np.int32)
            np.cumsum(~ones, out=zeros[1:])
            order = np.concatenate((np.flatnonzero(~ones), np.flatnonzero(ones)))
            ranks, summed = ranks[order], None
            if weights is not None:
                weights = weights[order]
                summed = np.concatenate((np.zeros(1, np.int64), np.cumsum(weights)))
            self.levels.append((bit, zeros, int(zeros[-1]), summed))

    def less(self, l: np.ndarray, r: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many values of each range are below v."""
        at, out = np.searchsorted(self.values, v), np.zeros(len(v), np.int64)
        for bit, zeros, n, summed in self.levels:
            one, a, b = (at >> bit) & 1 == 1, zeros[l], zeros[r]
            out += np.where(one, b - a if summed is None else summed[b] - summed[a], 0)
            l, r = np.where(one, n + l - a, a), np.where(one, n + r - b, b)
        return out

    def kth(self, l: np.ndarray, r: np.ndarray, k: np.ndarray) -> np.ma.MaskedArray:
        """The k-th smallest value of each range, masked where there is none."""
        none = (k < 0) | (k >= r - l)
        if not len(self.values) or none.all():
            return np.ma.masked_all(len(k), np.int64)
        l, r, k, at = np.where(none, 0, l), np.where(none, 1, r), np.where(none, 0, k), np.zeros(len(k), np.int64)
        for bit, zeros, n, _ in self.levels:
            a, b = zeros[l], zeros[r]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            at |= one.astype(np.int64) << bit
            l, r = np.where(one, n + l - a, a), np.where(one, n + r - b, b)
        return np.ma.array(self.values[at], mask=none)


def column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


def nullable(x: np.ma.MaskedArray) -> pa.Array:
    return pa.array(x.data, mask=np.ma.getmaskarray(x))


def met(rows: DataFrame, asked: DataFrame, answer: Callable[[int, pa.Table, pa.Table], dict], fields: list[str]) -> DataFrame:
    """(qid, fields): what ``answer`` says of each group's rows (_g, _x, _y, _v) and questions (_g, qid, _x, _y, _v, _w); groups with many questions are shared out."""
    kind = asked.schema["qid"]
    crowded = asked.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("_n")).where("_n > 1")
    crowded = asked.sparkSession.createDataFrame([tuple(r) for r in crowded.collect()], "_g long, _n long")  # at most a row for SHARE questions
    shares = F.coalesce("_n", F.lit(1).cast("long"))
    own = rows.join(F.broadcast(crowded), "_g", "left").select("_g", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("_part"), F.lit(None).cast(kind.dataType).alias("qid"), F.lit(False).alias("_q"), "_x", "_y", "_v", F.lit(0).cast("long").alias("_w"))
    others = asked.join(F.broadcast(crowded), "_g", "left").select("_g", F.pmod(F.xxhash64("qid", "_x", "_y"), shares).alias("_part"), "qid", F.lit(True).alias("_q"), "_x", "_y", "_v", "_w")
    schema = StructType([kind, *[StructField(f, LongType()) for f in fields]])
    names = schema.fieldNames()

    def told(key: tuple, t: pa.Table) -> pa.Table:
        asks = t["_q"].to_numpy()
        there, here = np.flatnonzero(asks), np.flatnonzero(~asks)
        here = here[np.argsort(column(t, "_x")[here], kind="stable")]
        questions = t.take(pa.array(there))
        found = answer(key[0].as_py(), t.take(pa.array(here)), questions)
        found = {"qid": questions["qid"]} | found
        return pa.table([found[n] for n in names], names=names)

    return own.unionByName(others).groupBy("_g", "_part").applyInArrow(told, schema)


def chunk_of(v: Column, df: DataFrame, edges: list[int], name: str) -> DataFrame:
    """Adds how many of the ascending ``edges`` are at or below ``v``, by halving."""
    steps = len(edges).bit_length()
    padded = edges + [None] * ((1 << steps) - len(edges))
    at = F.array(*[F.lit(e).cast("long") for e in padded])
    df = df.withColumn(name, F.lit(0))
    for s in range(steps - 1, -1, -1):
        there = F.get(at, F.col(name) + ((1 << s) - 1))
        df = df.withColumn(name, F.col(name) + F.when(there <= v, 1 << s).otherwise(0))
    return df


def counts_in_ranges(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, n): how many values of ``[l, r)`` are below ``hi``, and if there is a column ``lo`` not below that, for each row (qid, l, r, hi, lo) of ``asked`` where any are."""
    rows = rows.where("value IS NOT NULL").select(F.col("pos").cast("long").alias("pos"), F.col("value").alias("_v"))
    top = rows.agg(F.max("pos")).first()[0]
    bounded = "lo" in asked.columns
    low = F.col("lo") if bounded else F.lit(None)
    asked = asked.select("qid", F.greatest(F.col("l").cast("long"), F.lit(0)).alias("_x"), F.least(F.col("r").cast("long"), F.lit(-1 if top is None else top) + 1).alias("_y"), low.cast("long").alias("_w"), F.col("hi").cast("long").alias("_v"))
    asked = asked.where("_x < _y AND _v IS NOT NULL" + " AND _w < _v" * bounded)
    if top is None:
        return asked.select("qid", F.lit(0).cast("long").alias("n"))
    side = max(SIDE, -(-(top + 1) // MOST))

    def block(c: str) -> Column:
        return F.expr(f"{c} div {side}")

    entries = written(rows.groupBy("_v", block("pos").alias("_x")).agg(F.count(F.lit(1)).alias("_y")), "range-entries")
    chunks = min(MOST, -(-entries.count() // SIDE))
    edges = entries.agg(F.percentile_approx("_v", F.array(*[F.lit(i / chunks) for i in range(1, chunks)]), F.lit(max(10_000, 20 * chunks)))).first()[0] if chunks > 1 else []
    edges = sorted(set(edges))
    table = chunk_of(F.col("_v"), entries, edges, "_c").groupBy("_c", "_x").agg(F.sum("_y").alias("_y")).toArrow()  # at most MOST squared
    before = np.zeros((len(edges) + 2, top // side + 3), np.int64)
    np.add.at(before, (column(table, "_c") + 1, column(table, "_x") + 1), column(table, "_y"))
    before = before.cumsum(0).cumsum(1)

    asked = asked.withColumns({"_a": block("_x"), "_b": block("_y")})
    one = F.col("_a") == F.col("_b")
    parts = F.array(
        F.struct(F.col("_b").alias("_g"), F.when(one, F.col("_x")).otherwise(F.lit(0)).alias("_x"), F.col("_y").alias("_y")),
        F.when(~one & (F.col("_x") > F.col("_a") * side), F.struct(F.col("_a").alias("_g"), (-F.col("_x")).alias("_x"), F.lit(-1).cast("long").alias("_y"))),
    )
    ends = asked.select("qid", "_v", "_w", F.explode(F.array_compact(parts)).alias("_p")).select("_p._g", "qid", "_p._x", "_p._y", "_v", "_w")
    values = F.array_compact(F.array(F.struct(F.col("_v").alias("_v"), F.lit(1).cast("long").alias("_w")), F.when(F.col("_w").isNotNull(), F.struct(F.col("_w").alias("_v"), F.lit(-1).cast("long").alias("_w")))))
    between = asked.where("_a < _b").select("qid", F.col("_a").alias("_x"), F.col("_b").alias("_y"), F.explode(values).alias("_p")).select("qid", "_x", "_y", "_p._v", "_p._w")
    between = chunk_of(F.col("_v"), between, edges, "_c").select((-1 - F.col("_c")).cast("long").alias("_g"), "qid", "_x", "_y", "_v", "_w")
    own = rows.select(block("pos").alias("_g"), F.col("pos").alias("_x"), F.lit(1).cast("long").alias("_y"), "_v")
    own = own.unionByName(chunk_of(F.col("_v"), entries, edges, "_c").select((-1 - F.col("_c")).cast("long").alias("_g"), "_x", "_y", "_v"))

    def answer(g: int, here: pa.Table, there: pa.Table) -> dict:
        places, x, y, v = column(here, "_x"), column(there, "_x"), column(there, "_y"), column(there, "_v")
        if g < 0:
            matrix = Matrix(column(here, "_v"), column(here, "_y"))
            n = matrix.less(np.searchsorted(places, x), np.searchsorted(places, y), v) + before[-1 - g][y] - before[-1 - g][x]
            return {"n": pa.array(n * column(there, "_w"))}
        matrix = Matrix(column(here, "_v"))
        sign = np.where(y < 0, -1, 1)  # what is before the range's start, in its block
        l, r = np.searchsorted(places, np.where(y < 0, 0, x)), np.searchsorted(places, np.where(y < 0, -x, y))
        n = matrix.less(l, r, v)
        if bounded:
            n -= matrix.less(l, r, column(there, "_w"))
        return {"n": pa.array(n * sign)}

    found = met(own, ends.unionByName(between), answer, ["n"])
    return found.groupBy("qid").agg(F.sum("n").alias("n"))


def in_windows(rows: DataFrame, asked: DataFrame, column_of: str, fields: tuple[str, ...]) -> DataFrame:
    """(qid, fields) for ranges ``[l, r)`` of at most NEAR positions: ``kth``, the smallest value of the 0-based rank in ``column_of``, or predecessor and successor of the value there; null where there is none."""
    size = SIDE
    pos = F.col("pos").cast("long")
    block = F.floor(pos / size)
    windows = F.when((F.pmod(pos, F.lit(size)) < NEAR) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    own = rows.where("value IS NOT NULL").select(F.explode(windows).alias("_g"), pos.alias("_x"), F.lit(1).cast("long").alias("_y"), F.col("value").alias("_v"))
    left = F.greatest(F.col("l").cast("long"), F.lit(0))
    asked = asked.select(F.floor(left / size).alias("_g"), "qid", left.alias("_x"), F.col("r").cast("long").alias("_y"), F.col(column_of).cast("long").alias("_v"), F.lit(0).cast("long").alias("_w")).where("_x < _y AND _v IS NOT NULL")

    def answer(g: int, here: pa.Table, there: pa.Table) -> dict:
        places, v = column(here, "_x"), column(there, "_v")
        matrix, l, r = Matrix(column(here, "_v")), np.searchsorted(places, column(there, "_x")), np.searchsorted(places, column(there, "_y"))
        if "kth" in fields:
            return {"kth": nullable(matrix.kth(l, r, v))}
        less = matrix.less(l, r, v)
        return {n: nullable(matrix.kth(l, r, less - int(n == "predecessor"))) for n in fields}

    return met(own, asked, answer, list(fields))
