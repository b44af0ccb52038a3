"""Registered queries on integer sequences: E is events (event_id, user_id), O is orders (o_orderkey, o_custkey)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlytics.functions.words import bit_width
from seqlytics.operators import runs, sequence
from seqlytics.sources.scratch import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

E_SQL = "WITH e AS (SELECT event_id AS pos, user_id AS value FROM events), "
Q_SQL = "q AS (SELECT event_id AS qid, user_id AS v, event_id AS p, event_id // 3 AS l, event_id AS r, event_id % 40 AS k, user_id AS lo, user_id + 25 AS hi FROM events) "
O_SQL = "WITH o AS (SELECT o_orderkey AS pos, o_custkey AS value FROM orders), "
P_SQL = "q AS (SELECT o_orderkey AS qid, o_custkey AS v, greatest(o_orderkey - 500, 0) AS l, o_orderkey AS r, o_orderkey % 450 AS k FROM orders) "
#: The scalar ranges of the queries below, as shares of the sequence: from a fifth to four fifths.
LEFT, RIGHT = "(SELECT max(event_id) // 5 FROM events)", "(SELECT max(event_id) * 4 // 5 FROM events)"


def registered(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def div(c: str, n: int) -> F.Column:
    return F.expr(f"`{c}` div {n}")


def e_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("value"))


def o_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("value"))


def e_asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every event asks about its own user and a range that ends at it."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(e.alias("qid"), u.alias("v"), e.alias("p"), div("event_id", 3).alias("l"), e.alias("r"), (e % 40).alias("k"), u.alias("lo"), (u + 25).alias("hi"))


def o_asked(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(o.alias("qid"), F.col("o_custkey").alias("v"), F.greatest(o - 500, F.lit(0)).alias("l"), o.alias("r"), (o % 450).alias("k"))


def bounds(rows: DataFrame) -> tuple[int, int]:
    """From a fifth to four fifths of the positions."""
    top = rows.agg(F.max("pos")).first()[0] or 0
    return top // 5, top * 4 // 5


def width_of(rows: DataFrame) -> int:
    return bit_width(rows.agg(F.max("value")).first()[0] or 0)


@registered("seq_access", E_SQL + Q_SQL + "SELECT qid, e.value FROM q JOIN e ON e.pos = q.p")
def seq_access(spark, sf):
    return e_asked(spark, sf).join(e_rows(spark, sf), F.col("p") == F.col("pos")).select("qid", "value")


@registered("seq_access_rank", E_SQL.rstrip(", ") + " SELECT pos, value, row_number() OVER (PARTITION BY value ORDER BY pos) - 1 AS rank_before FROM e")
def seq_access_rank(spark, sf):
    return sequence.access_rank(e_rows(spark, sf))


@registered("seq_rank", E_SQL + Q_SQL + "SELECT qid, (SELECT count(*) FROM e WHERE e.value = q.v AND e.pos < q.p) AS rank FROM q")
def seq_rank(spark, sf):
    return sequence.rank_batch(e_rows(spark, sf), e_asked(spark, sf)).select("qid", "rank")


@registered("seq_rank_incl", E_SQL + Q_SQL + "SELECT qid, (SELECT count(*) FROM e WHERE e.value = q.v AND e.pos <= q.p) AS rank_incl FROM q")
def seq_rank_incl(spark, sf):
    return sequence.rank_batch(e_rows(spark, sf), e_asked(spark, sf), inclusive=True, name="rank_incl").select("qid", "rank_incl")


@registered("seq_rank_pair", E_SQL + Q_SQL + "SELECT qid, (SELECT count(*) FROM e WHERE e.value = q.v AND e.pos < q.l) AS left_rank, (SELECT count(*) FROM e WHERE e.value = q.v AND e.pos < q.r) AS right_rank FROM q")
def seq_rank_pair(spark, sf):
    return sequence.rank_pair_batch(e_rows(spark, sf), e_asked(spark, sf)).select("qid", "left_rank", "right_rank")


@registered("seq_rank_range", E_SQL + Q_SQL + "SELECT qid, (SELECT count(*) FROM e WHERE e.value = q.v AND e.pos >= q.l AND e.pos < q.r) AS n FROM q")
def seq_rank_range(spark, sf):
    return seq_rank_pair(spark, sf).select("qid", (F.col("right_rank") - F.col("left_rank")).alias("n"))


SELECTED = "s AS (SELECT value, pos, row_number() OVER (PARTITION BY value ORDER BY pos) - 1 AS k FROM e) SELECT qid, coalesce(s.pos, -1) AS selected FROM q LEFT JOIN s ON s.value = q.v AND s.k = "


@registered("seq_select", E_SQL + Q_SQL + ", " + SELECTED + "q.k")
def seq_select(spark, sf):
    return sequence.select_batch(e_rows(spark, sf), e_asked(spark, sf)).select("qid", "selected")


@registered("seq_select_nth", E_SQL + Q_SQL + ", " + SELECTED + "q.k - 1")
def seq_select_nth(spark, sf):
    return sequence.select_batch(e_rows(spark, sf), e_asked(spark, sf).withColumn("k", F.col("k") - 1)).select("qid", "selected")


@registered("seq_select_missing", E_SQL + Q_SQL + ", " + SELECTED + "q.k + 1000000")
def seq_select_missing(spark, sf):
    return sequence.select_batch(e_rows(spark, sf), e_asked(spark, sf).withColumn("k", F.col("k") + 1000000)).select("qid", "selected")


@registered("seq_count_less", E_SQL + Q_SQL + "SELECT qid, (SELECT count(*) FROM e WHERE e.value < q.v AND e.pos >= q.l AND e.pos < q.r) AS n_less FROM q")
def seq_count_less(spark, sf):
    return sequence.count_less_batch(e_rows(spark, sf), e_asked(spark, sf)).select("qid", "n_less")


@registered("seq_rank_less", E_SQL + Q_SQL + "SELECT qid, (SELECT count(*) FROM e WHERE e.value < q.v AND e.pos < q.p) AS n_less FROM q")
def seq_rank_less(spark, sf):
    return sequence.count_less_batch(e_rows(spark, sf), e_asked(spark, sf).withColumn("l", F.lit(0).cast("long"))).select("qid", "n_less")


@registered("seq_occ_position", E_SQL + Q_SQL + "SELECT qid, (SELECT count(*) FROM e WHERE e.value < q.v OR (e.value = q.v AND e.pos < q.p)) AS occ FROM q")
def seq_occ_position(spark, sf):
    return sequence.occ_position_batch(e_rows(spark, sf), e_asked(spark, sf)).select("qid", "occ")


@registered("seq_lsb_order", O_SQL + P_SQL + "SELECT qid, (SELECT count(*) FROM o WHERE o.value < q.v AND o.pos < q.r) AS n_less, (SELECT count(*) FROM o WHERE o.value < q.v + 1) - (SELECT count(*) FROM o WHERE o.value = q.v AND o.pos >= q.r) AS occ FROM q")
def seq_lsb_order(spark, sf):
    """What a table with numeric terminal order answers on order: smaller values before a position, and a value's place there."""
    rows, asked = o_rows(spark, sf), o_asked(spark, sf).withColumn("l", F.lit(0).cast("long"))
    less = sequence.count_less_batch(rows, asked).select("qid", "n_less")
    return sequence.occ_position_batch(rows, asked, at="r").join(less, "qid").select("qid", "n_less", "occ")


@registered("seq_range_freq", E_SQL + Q_SQL + "SELECT qid, (SELECT count(*) FROM e WHERE e.value >= q.lo AND e.value < q.hi AND e.pos >= q.l AND e.pos < q.r) AS n_in FROM q")
def seq_range_freq(spark, sf):
    return sequence.range_freq_batch(e_rows(spark, sf), e_asked(spark, sf)).select("qid", "n_in")


@registered("seq_quantile", O_SQL + P_SQL + ", s AS (SELECT q.qid, q.k, o.value, row_number() OVER (PARTITION BY q.qid ORDER BY o.value) - 1 AS i FROM q JOIN o ON o.pos >= q.l AND o.pos < q.r) SELECT q.qid, s.value AS quantile FROM q LEFT JOIN s ON s.qid = q.qid AND s.i = q.k")
def seq_quantile(spark, sf):
    return sequence.quantile_batch(o_rows(spark, sf), o_asked(spark, sf)).select("qid", "quantile")


@registered("seq_predecessor", O_SQL + P_SQL + "SELECT qid, (SELECT max(o.value) FROM o WHERE o.value < q.v AND o.pos >= q.l AND o.pos < q.r) AS predecessor FROM q")
def seq_predecessor(spark, sf):
    return sequence.neighbour_batch(o_rows(spark, sf), o_asked(spark, sf), ("predecessor",)).select("qid", "predecessor")


@registered("seq_successor", O_SQL + P_SQL + "SELECT qid, (SELECT min(o.value) FROM o WHERE o.value >= q.v AND o.pos >= q.l AND o.pos < q.r) AS successor FROM q")
def seq_successor(spark, sf):
    return sequence.neighbour_batch(o_rows(spark, sf), o_asked(spark, sf), ("successor",)).select("qid", "successor")


@registered("seq_value_counts", "SELECT user_id AS value, count(*) AS frequency FROM events GROUP BY user_id")
def seq_value_counts(spark, sf):
    return sequence.value_counts(e_rows(spark, sf))


@registered("seq_value_counts_range", f"SELECT user_id AS value, count(*) AS frequency FROM events WHERE event_id >= {LEFT} AND event_id < {RIGHT} GROUP BY user_id")
def seq_value_counts_range(spark, sf):
    rows = e_rows(spark, sf)
    return sequence.value_counts(rows, *bounds(rows))


@registered("seq_distinct", "SELECT DISTINCT user_id AS value FROM events")
def seq_distinct(spark, sf):
    return e_rows(spark, sf).select("value").distinct()


@registered("seq_distinct_range", f"SELECT DISTINCT user_id AS value FROM events WHERE event_id >= {LEFT} AND event_id < {RIGHT}")
def seq_distinct_range(spark, sf):
    rows = e_rows(spark, sf)
    return sequence.value_counts(rows, *bounds(rows)).select("value")


#: A value's bits, reversed, as text that sorts like the reversed value.
REVERSED = "reverse(lpad(bin(value), greatest((SELECT length(bin(max(user_id))) FROM events), 1)::INT, '0'))"
#: A value's base-4 digits, reversed; zeros behind the highest digit do not change the order.
DIGITS = "list_reduce(list_transform(range(0, 16), lambda i: ((value >> (2 * i)::INT) & 3)::VARCHAR), lambda a, b: a || b)"


@registered(
    "seq_value_count_intervals",
    f"WITH e AS (SELECT event_id AS pos, user_id AS value FROM events), c AS (SELECT value, count(*) AS n, count(*) FILTER (pos < {LEFT}) AS a, count(*) FILTER (pos < {RIGHT}) AS b FROM e GROUP BY value), "
    f"s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY {REVERSED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c) SELECT value, b - a AS frequency, (base + a)::BIGINT AS first, (base + b)::BIGINT AS past FROM s WHERE b > a",
)
def seq_value_count_intervals(spark, sf):
    rows = e_rows(spark, sf)
    return sequence.final_intervals(rows, "msb", width_of(rows), *bounds(rows))


def terminal(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf):
        rows = e_rows(spark, sf)
        return sequence.terminal_permutation(rows, kind, width_of(rows))

    return query


for _kind, _order in (("msb", REVERSED), ("lsb", "value"), ("quad", DIGITS)):
    registered(f"seq_terminal_{_kind}", f"WITH e AS (SELECT event_id AS pos, user_id AS value FROM events) SELECT pos, value, row_number() OVER (ORDER BY {_order}, pos) - 1 AS terminal FROM e")(terminal(_kind))


@registered("seq_terminal_interval", f"WITH c AS (SELECT user_id AS value, count(*) AS n FROM events GROUP BY user_id), s AS (SELECT value, sum(n) OVER (ORDER BY {REVERSED}) AS past, n FROM c) SELECT value, (past - n)::BIGINT AS first, past::BIGINT AS past FROM s")
def seq_terminal_interval(spark, sf):
    rows = e_rows(spark, sf)
    bases = sequence.terminal_bases(rows, "msb", width_of(rows))
    return bases.select("value", F.col("base").alias("first"), (F.col("base") + F.col("frequency")).alias("past"))


@registered("seq_matches_at", E_SQL + Q_SQL + "SELECT qid, e.value = q.lo + (q.qid % 2) AS matches FROM q JOIN e ON e.pos = q.p")
def seq_matches_at(spark, sf):
    return e_asked(spark, sf).join(e_rows(spark, sf), F.col("p") == F.col("pos")).select("qid", (F.col("value") == F.col("lo") + F.col("qid") % 2).alias("matches"))


@registered("seq_value_in_range_at", E_SQL + Q_SQL + "SELECT qid, e.value BETWEEN 10 AND 70 AS inside FROM q JOIN e ON e.pos = q.p")
def seq_value_in_range_at(spark, sf):
    return e_asked(spark, sf).join(e_rows(spark, sf), F.col("p") == F.col("pos")).select("qid", F.col("value").between(10, 70).alias("inside"))


def islands(where: str, of: str = "event_id", table: str = "events") -> str:
    return f"WITH h AS (SELECT {of} AS pos, {of} - row_number() OVER (ORDER BY {of}) AS g FROM {table} WHERE {where}) SELECT min(pos) AS first, max(pos) + 1 AS past FROM h GROUP BY g"


@registered("seq_matching_runs", islands("user_id % 2 = 0"))
def seq_matching_runs(spark, sf):
    return runs.matching_runs(e_rows(spark, sf), F.col("value") % 2 == 0)


@registered("seq_range_runs", islands("user_id BETWEEN 2 AND 90"))
def seq_range_runs(spark, sf):
    return runs.matching_runs(e_rows(spark, sf), F.col("value").between(2, 90))


@registered("seq_runs_windowed", islands(f"user_id BETWEEN 2 AND 90 AND event_id >= {LEFT} AND event_id < {RIGHT}"))
def seq_runs_windowed(spark, sf):
    rows = e_rows(spark, sf)
    return runs.matching_runs(rows, F.col("value").between(2, 90), *bounds(rows))


@registered("seq_select_cursor", "SELECT event_id AS pos, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events WHERE user_id = 3")
def seq_select_cursor(spark, sf):
    return sequence.access_rank(e_rows(spark, sf).where("value = 3")).select("pos", F.col("rank_before").alias("k"))
