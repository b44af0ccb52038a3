"""Suffix array, BWT and run-length symbols of a dictionary's text ``% s0 % s1 % ... % $``.

Symbols are 0 for the end ``$``, byte + 1, and 257 for the separator ``%``. The suffix array is built by prefix doubling: each round ranks pairs of ranks
by a distributed sort and doubles the compared length. Every round is a written table; text of any size goes through, in log2(longest repeat) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlytics import guards
from seqlytics.operators import storage
from seqlytics.operators.positions import BLOCK, block_of, dense_positions, ordinals, running_before, sums_in_order
from seqlytics.sources.scratch import written

#: Fixed values.
END, SEPARATOR, ALPHABET = 0, 257, 258


def encode_byte(byte: int) -> int:
    """The symbol of a byte."""
    if not 0 <= byte <= 255:
        raise ValueError("a byte is 0 to 255")
    return byte + 1


def decode_byte(symbol: int) -> int:
    """The byte of a symbol; ValueError for the end and the separator."""
    if not END < symbol < SEPARATOR:
        raise ValueError("the symbol is not a byte's")
    return symbol - 1


def text_symbols(strings: DataFrame) -> DataFrame:
    """(pos, sym, id): the text of (id, s), ids dense from 0 in their order. Starts of strings are running sums of lengths."""
    b = strings.select("id", F.col("s").cast("binary").alias("b")).withColumn("len", F.octet_length("b").cast("long"))
    placed = sums_in_order(b.select("id", "len"), ("id",), {"bytes_before": "len"})
    starts = b.join(placed.select("id", (F.col("bytes_before") + F.col("id")).alias("start")), "id")
    codes = F.expr("transform(sequence(1, len), i -> conv(hex(substring(b, i, 1)), 16, 10))")
    body = starts.where("len > 0").select("id", "start", F.posexplode(codes).alias("i", "code"))
    body = body.select((F.col("start") + 1 + F.col("i")).alias("pos"), (F.col("code").cast("int") + 1).alias("sym"), "id")
    marks = starts.select(F.col("start").alias("pos"), F.lit(SEPARATOR).alias("sym"), "id")
    tail = b.agg((F.coalesce(F.sum("len"), F.lit(0)) + F.count(F.lit(1))).alias("n"))
    ends = tail.select(F.explode(F.array(F.struct(F.col("n").alias("pos"), F.lit(SEPARATOR).alias("sym")), F.struct((F.col("n") + 1).alias("pos"), F.lit(END).alias("sym")))).alias("e")).select("e.pos", "e.sym", F.lit(None).cast("long").alias("id"))
    return body.unionByName(marks).unionByName(ends).select(F.col("pos").cast("long"), "sym", F.col("id").cast("long"))


def pair_ranks(pairs: DataFrame) -> DataFrame:
    """(pos, rank) from (pos, a, b): how many rows have a smaller pair. Distinct pairs are numbered first, their counts summed in that order."""
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    numbered = dense_positions(counts, ("a", "b"), "i")
    return pairs.join(running_before(numbered, "i", {"rank": F.col("n")}).select("a", "b", "rank"), ["a", "b"]).select("pos", "rank")


def suffix_array(text: DataFrame) -> DataFrame:
    """(row, pos) of (pos, sym): the position of the row-th smallest suffix."""
    n = text.count()
    ranks = written(pair_ranks(text.select("pos", F.col("sym").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))), "ranks")
    step = 1
    while step < n and ranks.select(F.count_distinct("rank")).first()[0] < n:
        far = ranks.select((F.col("pos") - step).alias("pos"), (F.col("rank") + 1).alias("b"))
        pairs = ranks.withColumnRenamed("rank", "a").join(far, "pos", "left").withColumn("b", F.coalesce("b", F.lit(0)).cast("long"))
        ranks = written(pair_ranks(pairs), "ranks")
        step *= 2
    return ranks.select(F.col("rank").alias("row"), "pos")


def bwt(text: DataFrame, array: DataFrame) -> DataFrame:
    """(row, sym): the symbol before each suffix, cyclically."""
    n = text.count()
    before = array.select("row", F.pmod(F.col("pos") - 1, F.lit(n)).alias("pos"))
    return before.join(text.select("pos", "sym"), "pos").select("row", "sym")


def symbol_starts(transformed: DataFrame) -> DataFrame:
    """(sym, n, start): how many symbols are smaller than each. At most ALPHABET rows are ordered."""
    counts = transformed.groupBy("sym").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def last_to_first(transformed: DataFrame) -> DataFrame:
    """(row, sym, lf): the row whose suffix begins with the row's symbol."""
    ranked = ordinals(transformed, "row", ("sym",), "k").join(symbol_starts(transformed).select("sym", "start"), "sym")
    return ranked.select("row", "sym", (F.col("start") + F.col("k")).cast("long").alias("lf"))


def symbol_runs(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(run, sym, first, past): maximal runs of equal symbols of dense (pos, sym).

    Runs are found within blocks of positions; those that a block's end cuts are put together over the table of these pieces, at most as many as there are runs and blocks.
    """
    own = Window.partitionBy("_b").orderBy("pos")
    changed = F.coalesce(F.lag("sym").over(own) != F.col("sym"), F.lit(True))
    blocked = rows.select("pos", "sym", block_of("pos", size).alias("_b"))
    starts = blocked.withColumn("_c", changed).where("_c").drop("_c")
    # The first piece of a block goes on with the run of the block before, if the symbols are the same.
    lasts = rows.where(F.pmod(F.col("pos") + 1, F.lit(size)) == 0).select((F.col("pos") + 1).alias("pos"), F.col("sym").alias("_before"))
    true = written(starts.join(lasts, "pos", "left").where("_before IS NULL OR _before <> sym").select("pos", "sym"), "run-starts")
    numbered = dense_positions(true, ("pos",), "run")
    n = rows.agg((F.max("pos") + 1).alias("n"))
    following = numbered.select((F.col("run") - 1).alias("run"), F.col("pos").alias("past"))
    return numbered.join(following, "run", "left").crossJoin(F.broadcast(n)).select("run", "sym", F.col("pos").alias("first"), F.coalesce("past", "n").alias("past"))  # n is one row


def backward_search(transformed: DataFrame, pattern: bytes) -> tuple[int, int]:
    """The half-open interval of rows whose suffixes start with ``pattern``: two counts for each byte."""
    starts = {r["sym"]: (r["start"], r["n"]) for r in symbol_starts(transformed).collect()}  # ALPHABET rows at most
    left, right = 0, sum(n for _, n in starts.values())
    for byte in reversed(pattern):
        base, _ = starts.get(byte + 1, (0, 0))
        same = F.col("sym") == byte + 1
        a, b = transformed.agg(F.count_if(same & (F.col("row") < left)), F.count_if(same & (F.col("row") < right))).first()
        left, right = base + a, base + b
        if left >= right:
            return left, left
    return left, right


class RunLengthColumn:
    """Symbols (pos, sym) kept as runs (run, sym, first, past); questions read the runs."""

    def __init__(self, rows: DataFrame) -> None:
        self.n = rows.count()
        self.runs = written(symbol_runs(rows), "runs")

    def memory_usage(self) -> int:
        return storage.run_length_bytes(self.n, self.run_count())

    def run_count(self) -> int:
        return self.runs.count()

    def access(self, i: int) -> int:
        guards.check_index(i, self.n)
        return self.runs.where((F.col("first") <= i) & (F.col("past") > i)).first()["sym"]

    def rank(self, sym: int, p: int) -> int:
        guards.check_position(p, self.n)
        inside = F.greatest(F.lit(0), F.least("past", F.lit(p)) - F.col("first"))
        return self.runs.where(F.col("sym") == sym).agg(F.coalesce(F.sum(inside), F.lit(0))).first()[0]

    def access_rank(self, i: int) -> tuple[int, int]:
        sym = self.access(i)
        return sym, self.rank(sym, i)

    def rank_pair(self, sym: int, left: int, right: int) -> tuple[int, int]:
        guards.check_range(left, right, self.n)
        return self.rank(sym, left), self.rank(sym, right)

    def select(self, sym: int, k: int) -> int:
        if k < 0:
            return -1
        own = running_before(self.runs.where(F.col("sym") == sym), "run", {"before": F.col("past") - F.col("first")})
        hit = own.where((F.col("before") <= k) & (F.col("before") + F.col("past") - F.col("first") > k)).first()
        return -1 if hit is None else hit["first"] + k - hit["before"]


def run_statistics(transformed: DataFrame) -> DataFrame:
    """One row: length, runs, their ratio, average and maximum length of (row, sym)."""
    found = symbol_runs(transformed.select(F.col("row").alias("pos"), "sym"))
    size = F.col("past") - F.col("first")
    return found.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("runs"), (F.count(F.lit(1)) / F.sum(size)).alias("run_ratio"), (F.sum(size) / F.count(F.lit(1))).alias("average_run"), F.coalesce(F.max(size), F.lit(0)).alias("longest_run")
    )
