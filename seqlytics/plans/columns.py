"""Registered queries on bit, packed, four-symbol and sorted columns, and on permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlytics.operators import bits, ordered, runs, sequence, suffix
from seqlytics.operators.positions import count_before, dense_positions, running_before
from seqlytics.plans import sequences
from seqlytics.plans.sequences import LEFT, bounds, islands
from seqlytics.sources.scratch import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def b_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("event_type") == "click").alias("bit"))


def v_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") % 4).alias("sym"))


def x_rows(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long")
    return dense_positions(table(spark, sf, "orders").select(days.alias("x"), F.col("o_orderkey").alias("key")), ("x", "key"), "i").select("i", "x")


def p_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dense_positions(table(spark, sf, "orders").select("o_totalprice", F.col("o_orderkey").alias("idx")), ("o_totalprice", "idx"), "image").select("idx", "image")


B = "WITH b AS (SELECT event_id AS pos, event_type = 'click' AS bit FROM events) "
V = "WITH v AS (SELECT event_id AS pos, user_id % 4 AS sym FROM events), q AS (SELECT event_id AS qid, event_id AS p, user_id % 4 AS v, event_id % 900 AS k FROM events) "
X = "WITH x AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS x FROM orders), q AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 1 AS v FROM orders) "
P = "WITH RECURSIVE p AS (SELECT o_orderkey AS idx, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS image FROM orders) "


@registered("bits_rank", B + ", r AS (SELECT pos, bit, coalesce(sum(bit::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank1 FROM b) SELECT pos, bit, rank1, pos - rank1 AS rank0, rank1 + bit::BIGINT AS rank1_incl, pos + 1 - rank1 - bit::BIGINT AS rank0_incl FROM r")
def bits_rank(spark, sf):
    return bits.bit_ranks(b_rows(spark, sf))


@registered("bits_select", B + "SELECT bit, row_number() OVER (PARTITION BY bit ORDER BY pos) - 1 AS k, pos FROM b")
def bits_select(spark, sf):
    return bits.bit_selects(b_rows(spark, sf))


@registered(
    "bits_popcount_blocks",
    B + ", c AS (SELECT pos // 512 AS block, count(*) FILTER (bit) AS ones FROM b GROUP BY 1) SELECT block, ones, coalesce(sum(ones) OVER (PARTITION BY block // 16 ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c",
)
def bits_popcount_blocks(spark, sf):
    return bits.level_counts(b_rows(spark, sf), 1)


@registered("bits_rank_in_block", B + "SELECT pos, coalesce(sum(bit::INT) OVER (PARTITION BY pos // 512 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank FROM b")
def bits_rank_in_block(spark, sf):
    return bits.ranks_in_block(b_rows(spark, sf)).select("pos", "rank")


@registered("bits_runs", islands("event_type = 'click'"))
def bits_runs(spark, sf):
    return runs.matching_runs(b_rows(spark, sf), F.col("bit"))


@registered("packed_fit", "SELECT event_id AS pos, user_id AS value, user_id <= 127 AS fits FROM events")
def packed_fit(spark, sf):
    return sequences.e_rows(spark, sf).withColumn("fits", F.col("value") <= bits.mask_for_width(7))


@registered("packed_update", "SELECT event_id AS pos, CASE WHEN user_id < 9 THEN user_id * 3 ELSE user_id END AS value FROM events")
def packed_update(spark, sf):
    rows = sequences.e_rows(spark, sf)
    return bits.updated(rows, rows.where("value < 9").select("pos", (F.col("value") * 3).alias("value")), "value")


@registered("packed_fill", "SELECT event_id AS pos, 5::BIGINT AS value FROM events")
def packed_fill(spark, sf):
    return bits.PackedColumn(sequences.e_rows(spark, sf), 0, 7).fill(5).rows


@registered("quad_rank", V + "SELECT qid, (SELECT count(*) FROM v WHERE v.sym = q.v AND v.pos < q.p) AS rank FROM q")
def quad_rank(spark, sf):
    return sequence.rank_batch(v_values(spark, sf), v_asked(spark, sf)).select("qid", "rank")


def v_values(spark, sf):
    return v_rows(spark, sf).withColumnRenamed("sym", "value")


def v_asked(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(e.alias("qid"), e.alias("p"), (F.col("user_id") % 4).alias("v"), (e % 900).alias("k"))


@registered("quad_rank_all", V + "SELECT pos, sym, " + ", ".join(f"coalesce(sum((sym = {s})::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS r{s}" for s in range(4)) + " FROM v")
def quad_rank_all(spark, sf):
    return bits.symbol_ranks(v_rows(spark, sf))


@registered("quad_select", V + ", s AS (SELECT sym, pos, row_number() OVER (PARTITION BY sym ORDER BY pos) - 1 AS k FROM v) SELECT qid, coalesce(s.pos, -1) AS selected FROM q LEFT JOIN s ON s.sym = q.v AND s.k = q.k")
def quad_select(spark, sf):
    return sequence.select_batch(v_values(spark, sf), v_asked(spark, sf)).select("qid", "selected")


@registered("quad_access_rank", V + "SELECT pos, sym, row_number() OVER (PARTITION BY sym ORDER BY pos) - 1 AS rank_before FROM v")
def quad_access_rank(spark, sf):
    return sequence.access_rank(v_values(spark, sf)).withColumnRenamed("value", "sym")


@registered("sorted_access", X + "SELECT i, x FROM x")
def sorted_access(spark, sf):
    return x_rows(spark, sf)


def x_asked(spark, sf):
    days = F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long") + 1
    return table(spark, sf, "orders").select(days.alias("v")).distinct().withColumn("qid", F.col("v"))


def x_bounds(column: str, shown: str | None = None):
    def query(spark, sf):
        return ordered.bounds_batch(x_rows(spark, sf), x_asked(spark, sf)).select("v", F.expr(column).cast("long").alias(shown or column))

    return query


registered("sorted_lower_bound", X + "SELECT v, (SELECT count(*) FROM x WHERE x.x < q.v) AS lower_bound FROM q")(x_bounds("lower_bound"))
registered("sorted_upper_bound", X + "SELECT v, (SELECT count(*) FROM x WHERE x.x <= q.v) AS upper_bound FROM q")(x_bounds("upper_bound"))
registered("sorted_last_le", X + "SELECT v, (SELECT count(*) FROM x WHERE x.x <= q.v) - 1 AS last_le FROM q")(x_bounds("upper_bound - 1", "last_le"))
registered("sorted_predecessor", X + "SELECT v, (SELECT max(x.x) FROM x WHERE x.x <= q.v) AS predecessor FROM q")(x_bounds("predecessor"))
registered("sorted_counts", X + "SELECT v, (SELECT count(*) FROM x WHERE x.x = q.v) AS n FROM q")(x_bounds("upper_bound - lower_bound", "n"))


@registered("sorted_high_buckets", X + ", h AS (SELECT x >> 5 AS high, count(*) AS n FROM x GROUP BY 1) SELECT high, (sum(n) OVER (ORDER BY high) - n)::BIGINT AS first, (sum(n) OVER (ORDER BY high))::BIGINT AS past FROM h")
def sorted_high_buckets(spark, sf):
    return ordered.high_buckets(x_rows(spark, sf), 5)


@registered("perm_forward", P + "SELECT idx, image FROM p")
def perm_forward(spark, sf):
    return p_rows(spark, sf)


@registered("perm_inverse", P + "SELECT image AS idx, idx AS image FROM p")
def perm_inverse(spark, sf):
    return p_rows(spark, sf).select(F.col("image").alias("idx"), F.col("idx").alias("image"))


#: Cycles by following each index to its cycle's smallest would be quadratic; walking from every index that no smaller one reaches needs the result. Pointer doubling in SQL is one join a round.
CYCLES = ", d0 AS (SELECT idx, image, least(idx, image) AS lead FROM p)" + "".join(f", d{k} AS (SELECT a.idx, b.image, least(a.lead, b.lead) AS lead FROM d{k - 1} a JOIN d{k - 1} b ON b.idx = a.image)" for k in range(1, 19))


@registered("perm_cycles", P + CYCLES + ", n AS (SELECT lead, count(*) AS length FROM d18 GROUP BY lead) SELECT idx, d18.lead AS leader, length FROM d18 JOIN n ON n.lead = d18.lead")
def perm_cycles(spark, sf):
    return ordered.cycles(p_rows(spark, sf))


@registered("perm_landmarks", P + CYCLES + " SELECT lead AS leader, count(*) AS length, CASE WHEN count(*) > 8 THEN (count(*) + 7) // 8 ELSE 0 END::BIGINT AS landmarks FROM d18 GROUP BY lead")
def perm_landmarks(spark, sf):
    return ordered.landmark_counts(ordered.cycles(p_rows(spark, sf)), 8)


RUNS = V + ", c AS (SELECT pos, sym, CASE WHEN lag(sym) OVER (ORDER BY pos) = sym THEN 0 ELSE 1 END AS s FROM v), g AS (SELECT pos, sym, sum(s) OVER (ORDER BY pos) AS g FROM c), r AS (SELECT (g - 1)::BIGINT AS run, any_value(sym) AS sym, min(pos) AS first, max(pos) + 1 AS past FROM g GROUP BY g) "


@registered("rle_runs", RUNS + "SELECT run, sym, first, past FROM r")
def rle_runs(spark, sf):
    return suffix.symbol_runs(v_rows(spark, sf))


@registered("rle_rank", RUNS + "SELECT run, sym, (sum(past - first) OVER (PARTITION BY sym ORDER BY run) - (past - first))::BIGINT AS before FROM r")
def rle_rank(spark, sf):
    """How often a run's symbol occurs before the run."""
    found = suffix.symbol_runs(v_rows(spark, sf))
    return running_before(found, "run", {"before": F.col("past") - F.col("first")}, ("sym",)).select("run", "sym", "before")


@registered("rle_select", V + "SELECT sym, row_number() OVER (PARTITION BY sym ORDER BY pos) - 1 AS k, pos FROM v")
def rle_select(spark, sf):
    """All occurrences by symbol, out of runs: ordinals before the run, and places in it."""
    found = suffix.symbol_runs(v_rows(spark, sf))
    found = running_before(found, "run", {"before": F.col("past") - F.col("first")}, ("sym",))
    each = found.select("sym", "before", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("past") - F.col("first") - 1)).alias("j"))
    return each.select("sym", (F.col("before") + F.col("j")).alias("k"), (F.col("first") + F.col("j")).alias("pos"))


@registered("rle_access", RUNS + "SELECT q.qid, r.sym FROM q JOIN r ON q.p >= r.first AND q.p < r.past")
def rle_access(spark, sf):
    """The symbol at a position: that of the last run that starts at or before it."""
    found = suffix.symbol_runs(v_rows(spark, sf))
    at = count_before(found.select("first"), v_asked(spark, sf), (), "first", n=("p", True))
    return at.select("qid", (F.col("n") - 1).alias("run")).join(found, "run").select("qid", "sym")


@registered("bits_runs_windowed", islands(f"event_type = 'click' AND event_id >= {LEFT} AND event_id < (SELECT max(event_id) * 4 // 5 FROM events)"))
def bits_runs_windowed(spark, sf):
    rows = b_rows(spark, sf)
    return runs.matching_runs(rows, F.col("bit"), *bounds(rows))
