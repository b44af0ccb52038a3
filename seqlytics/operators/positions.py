"""Prefix sums, ordinals and ranges over dense positions, without a task that holds a whole column.

A window without partitions, or with one hot partition, moves all its rows to one task. All of these go in phases instead: sums by block of BLOCK
positions, running sums over a group of blocks and over the groups, and windows within blocks. Keys that are not dense are numbered by range partitions first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlytics.sources.scratch import written

BLOCK = 1 << 16
#: Blocks that are summed as a group before groups are: one task then orders a row for each 2**26 positions.
GROUP = 1 << 10
#: Ranges up to this many are broadcast, and each row is held against all of them.
BROADCAST_QUERIES = 64
#: Questions whose keys may be broadcast to leave out rows that nobody asks for.
ASKED = 1 << 14
#: Rows of a summary (values, blocks, strings) that one task may order.
ONE_TASK = 1 << 20
#: Bits of a value that one round of a k-th smallest looks at.
ROUND = 3


def block_of(pos: Column | str, size: int = BLOCK) -> Column:
    p = F.col(pos) if isinstance(pos, str) else pos
    return ((p - F.pmod(p, F.lit(size))) / size).cast("long")


def block_starts(blocked: DataFrame, sums: list[str], by: tuple[str, ...]) -> DataFrame:
    """(by, _b, _s_NAME): the sums of _v_NAME over all blocks before _b (within ``by``), from rows or partial sums of (by, _b, _v_NAME)."""
    totals = blocked.groupBy(*by, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]).withColumn("_g", block_of("_b", GROUP))
    groups = totals.groupBy(*by, "_g").agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in sums])

    def before(df: DataFrame, over: tuple[str, ...], order: str, prefix: str) -> DataFrame:
        w = Window.partitionBy(*over).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*by, order, *([] if order == "_g" else ["_g"]), *[F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(f"{prefix}_{n}") for n in sums])

    inner, outer = before(totals, (*by, "_g"), "_b", "_i"), before(groups, by, "_g", "_o")
    return inner.join(outer, [*by, "_g"]).select(*by, "_b", *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(f"_s_{n}") for n in sums])


def running_before(df: DataFrame, pos: str, sums: dict[str, Column], by: tuple[str, ...] = (), size: int = BLOCK) -> DataFrame:
    """Adds for each name the sum of its column over the rows of smaller ``pos`` (within ``by``). Positions are dense, or nearly so."""
    blocked = df.withColumn("_b", block_of(pos, size)).withColumns({f"_v_{n}": c for n, c in sums.items()})
    within = Window.partitionBy(*by, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    out = blocked.withColumns({f"_w_{n}": F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) for n in sums})
    out = out.join(block_starts(blocked, list(sums), by), [*by, "_b"])
    return out.select(*df.columns, *[(F.col(f"_s_{n}") + F.col(f"_w_{n}")).cast("long").alias(n) for n in sums])


def ordinals(df: DataFrame, pos: str, by: tuple[str, ...], name: str = "ordinal", size: int = BLOCK) -> DataFrame:
    """Adds how many rows with the same ``by`` have a smaller ``pos``."""
    return running_before(df, pos, {name: F.lit(1).cast("long")}, by, size)


def counts_at(rows: DataFrame, marks: DataFrame, by: tuple[str, ...], key: str, size: int = BLOCK) -> DataFrame:
    """The columns of ``marks`` (by, _k, _tag, ...) with _n, the number of ``rows`` (equal in ``by``) whose dense ``key`` is below _k, or at it if _tag is 1.

    Rows and marks are put in one order, a mark before or behind the row of its key.
    """
    payload = [c for c in marks.columns if c not in by]
    kind = F.struct(*[F.col(f"`{c}`") for c in payload])
    entries = rows.select(*by, F.col(key).cast("long").alias("_k"), F.lit(1).alias("_row"), F.lit(None).cast(marks.select(kind.alias("p")).schema["p"].dataType).alias("_p"))
    asked = marks.select(*by, F.col("_k"), F.when(F.col("_tag") == 1, 2).otherwise(0).alias("_row"), kind.alias("_p"))
    both = entries.unionByName(asked).withColumn("_b", block_of("_k", size)).withColumn("_v_n", F.when(F.col("_row") == 1, 1).otherwise(0).cast("long"))
    within = Window.partitionBy(*by, "_b").orderBy("_k", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_w", F.sum("_v_n").over(within)).where("_row <> 1").select(*by, "_b", "_p", "_w")
    return inside.join(block_starts(both, ["n"], by), [*by, "_b"]).select(*by, "_p.*", (F.col("_s_n") + F.col("_w")).cast("long").alias("_n"))


def asked_for(rows: DataFrame, queries: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``rows`` without those whose ``by`` no query has, where the queries are few (their number is checked)."""
    if by and few(queries, ASKED):
        return rows.join(F.broadcast(queries.select(*by).distinct()), list(by), "left_semi")
    return rows


def count_before(rows: DataFrame, queries: DataFrame, by: tuple[str, ...], key: str, size: int = BLOCK, **at: tuple[str, bool]) -> DataFrame:
    """``queries`` (with distinct qid) with a count for each name of ``at``: the ``rows`` equal in ``by`` whose dense ``key`` is below that column, or up to it if its flag is set."""
    each = F.array(*[F.struct(F.lit(n).alias("_name"), F.col(c).cast("long").alias("_k"), F.lit(int(upto)).alias("_tag")) for n, (c, upto) in at.items()])
    marks = queries.select(*by, "qid", F.explode(each).alias("_m")).select(*by, "qid", "_m._name", "_m._k", "_m._tag")
    found = counts_at(asked_for(rows, queries, by), marks, by, key, size)
    counts = found.groupBy("qid").agg(*[F.max(F.when(F.col("_name") == n, F.col("_n"))).alias(n) for n in at])
    return queries.join(counts, "qid")


def dense_positions(df: DataFrame, order: tuple[str, ...], name: str = "pos") -> DataFrame:
    """Adds 0-based positions in the order of ``order``, which must tell all rows apart. Range-partitioned, so no task sees all rows."""
    dealt = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    numbered = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "_p").select(*df.columns, (F.col("_s") + F.col("_r") - 1).cast("long").alias(name))


def few(df: DataFrame, most: int = ONE_TASK) -> bool:
    """Whether ``df``, a written table or a cheap plan, has at most ``most`` rows."""
    return df.count() <= most  # a limit would gather as many rows of every partition in one task


def sums_in_order(df: DataFrame, order: tuple[str, ...], sums: dict[str, str]) -> DataFrame:
    """Adds for each name the sum of its column over the rows before, in an order that tells all rows apart.

    Up to ONE_TASK rows, counted first, are ordered in one task; more are numbered by range partitions and summed in phases.
    """
    df = written(df, "ordered")
    if few(df):
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(n) for n, c in sums.items()])
    return running_before(dense_positions(df, order, "_pos"), "_pos", {n: F.col(c) for n, c in sums.items()}).drop("_pos")


def bounds(keys: DataFrame, key: str, asked: DataFrame, at: str) -> DataFrame:
    """(at, below, equal) for each distinct ``at`` of ``asked``: how many ``keys`` are smaller, and how many equal. Keys are counted by value, then put in one order with what is asked."""
    kind = keys.schema[key].dataType
    counted = keys.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_tag", F.lit(1))
    marks = asked.select(F.col(at).cast(kind).alias("_k")).where("_k IS NOT NULL").distinct().select("_k", F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_tag"))
    placed = sums_in_order(counted.unionByName(marks), ("_k", "_tag"), {"_before": "_n"})
    # A mark is right before the row of its key, which so has the same sum.
    found = placed.groupBy("_k").agg(F.min("_before").alias("below"), F.sum("_n").alias("equal"), F.min("_tag").alias("_tag")).where("_tag = 0")
    return found.select(F.col("_k").alias(at), "below", "equal")


def kth_position(rows: DataFrame, k: int, pos: str = "pos", size: int = BLOCK) -> int:
    """The k-th smallest position (0-based), or -1: the block that holds it is found by counts, then that block alone is ordered."""
    if k < 0:
        return -1
    counts = rows.groupBy(block_of(pos, size).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    placed = sums_in_order(counts, ("_b",), {"_before": "_n"})
    hit = placed.where((F.col("_before") <= k) & (F.col("_before") + F.col("_n") > k)).first()
    if hit is None:
        return -1
    return rows.where(block_of(pos, size) == hit["_b"]).orderBy(pos).offset(k - hit["_before"]).limit(1).first()[pos]


def range_rows(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of (pos, value) in each query's ``[l, r)``, with the query's columns. For few queries: they are broadcast, and nothing is shuffled."""
    return rows.join(F.broadcast(queries), (F.col("pos") >= F.col("l")) & (F.col("pos") < F.col("r")))


def _bits(rows: DataFrame) -> int:
    top = rows.agg(F.max("value")).first()[0]
    return (int(top) + 1).bit_length() if top is not None else 0


def _shifted(c: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", c, F.lit(bits) if isinstance(bits, int) else bits)


def kth_smallest(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, kth): the k-th smallest (0-based) value of ``[l, r)`` for each row (qid, l, r, k); no row where there is none.

    Digits of ROUND bits are settled from the highest down: the rows of each digit in the range are counted by rank questions. As many rounds as a value has digits.
    """
    rounds = -(-_bits(rows) // ROUND)
    state = asked.select("qid", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), F.col("k").cast("long").alias("k"), F.lit(0).cast("long").alias("top")).where("k >= 0 AND l < r")
    state = written(state, "kth")
    if not rounds:
        return state.where("false").select("qid", F.col("top").alias("kth"))
    fan = 1 << ROUND
    for t in range(rounds - 1, -1, -1):
        entries = rows.select("pos", _shifted(F.col("value"), t * ROUND).alias("_q"))
        ends = F.array(*[F.struct(F.lit(j).alias("_j"), F.col(c).alias("_k"), F.lit(s).alias("_s")) for j in range(fan) for c, s in (("l", -1), ("r", 1))])
        marks = state.select("*", F.explode(ends).alias("_m")).select("qid", "l", "r", "k", "top", "_m._j", "_m._k", "_m._s", F.lit(0).alias("_tag"), (F.col("top") * fan + F.col("_m._j")).alias("_q"))
        inside = [F.sum(F.when(F.col("_j") == j, F.col("_s") * F.col("_n"))).alias(f"_n{j}") for j in range(fan)]
        digits = counts_at(entries, marks, ("_q",), "pos").groupBy("qid", "l", "r", "k", "top").agg(*inside)
        upto = [sum((F.col(f"_n{i}") for i in range(j + 1)), F.lit(0)) for j in range(fan)]
        digit, before = F.lit(None).cast("int"), F.lit(0).cast("long")
        for j in range(fan - 1, -1, -1):
            digit = F.when(F.col("k") < upto[j], F.lit(j)).otherwise(digit)
            before = F.when(F.col("k") < upto[j], (upto[j - 1] if j else F.lit(0)).cast("long")).otherwise(before)
        state = digits.withColumn("_d", digit).where("_d IS NOT NULL").select("qid", "l", "r", (F.col("k") - before).alias("k"), (F.col("top") * fan + F.col("_d")).alias("top"))
        state = written(state, "kth")  # a round reads it twice, so plans would double
    return state.select("qid", F.col("top").alias("kth"))
