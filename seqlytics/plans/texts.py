"""Registered queries on string dictionaries: D is the distinct part names, DU the page urls, C the customer names, T the texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlytics.functions.words import bit_width
from seqlytics.operators import storage, suffix, textdict, trie, usage
from seqlytics.operators.positions import dense_positions
from seqlytics.sources.scratch import table, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def d_rows(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("key"))
    return dense_positions(first.select(F.col("p_name").alias("s"), "key"), ("key",), "id").select("id", "s")


def du_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("s"))


D = "WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY min(p_partkey)) - 1 AS id, p_name AS s FROM part GROUP BY p_name) "


def dictionary(spark, sf) -> textdict.TextDictionary:
    return textdict.TextDictionary(d_rows(spark, sf), distinct=False)


@registered("dict_exact", D + "SELECT q.p_partkey AS qid, d.id FROM part q JOIN d ON d.s = q.p_name")
def dict_exact(spark, sf):
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("s"))
    return dictionary(spark, sf).find_exact_batch(asked).where("id IS NOT NULL").select("qid", "id")


@registered("dict_contains", D + "SELECT p_partkey AS qid, p_partkey % 2 = 0 AS found FROM part")
def dict_contains(spark, sf):
    """Odd parts ask for their name with a mark behind it, which no name has."""
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.lit("\u0001"))).alias("s"))
    return dictionary(spark, sf).find_exact_batch(asked).select("qid", F.col("id").isNotNull().alias("found"))


@registered("dict_restore", D + "SELECT id, s FROM d")
def dict_restore(spark, sf):
    return dictionary(spark, sf).rows


@registered("dict_items", "SELECT page_id AS id, url AS s FROM pages")
def dict_items(spark, sf):
    return du_rows(spark, sf)


@registered("dict_prefix", "SELECT page_id AS id FROM pages WHERE starts_with(url, 'https://blog.')")
def dict_prefix(spark, sf):
    return textdict.TextDictionary(du_rows(spark, sf), distinct=False).find_prefix("https://blog.")


@registered("dict_prefix_trie_order", "SELECT page_id AS id, row_number() OVER (ORDER BY hex(encode(url))) - 1 AS ordinal FROM pages WHERE starts_with(url, 'https://')")
def dict_prefix_trie_order(spark, sf):
    found = textdict.TextDictionary(du_rows(spark, sf), distinct=False)._matching("https://", "startswith")
    return dense_positions(found.select("id", F.col("s").cast("binary").alias("b")), ("b", "id"), "ordinal").select("id", "ordinal")


@registered("dict_suffix", "SELECT page_id AS id FROM pages WHERE ends_with(url, '.html')")
def dict_suffix(spark, sf):
    return textdict.TextDictionary(du_rows(spark, sf), distinct=False).find_suffix(".html")


@registered("dict_substring", "SELECT doc_id AS id FROM documents WHERE contains(text, 'tion the')")
def dict_substring(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("s"))
    return textdict.TextDictionary(texts, distinct=False).find_substring("tion the")


@registered("dict_occurrences", "SELECT c_custkey AS id, len(list_filter(range(1, length(c_name) + 1), lambda i: substring(c_name, i, 2) = '00'))::BIGINT AS occurrences FROM customer WHERE contains(c_name, '00')")
def dict_occurrences(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("s"))
    return textdict.TextDictionary(names, distinct=False).find_substring_occurrences("00")


@registered("dict_empty_pattern", D + "SELECT id, strlen(s) + 1 AS occurrences FROM d")
def dict_empty_pattern(spark, sf):
    return dictionary(spark, sf).find_substring_occurrences("")


@registered("dict_duplicates", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def dict_duplicates(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("s"))
    return textdict.duplicates(texts).select(F.md5(F.col("s").cast("binary")).alias("digest"), "n", "first_id")


#: The nodes of the trie of a table d (id, s).
NODES_OF_D = (
    ", h AS (SELECT hex(encode(s)) AS prefix, id FROM d), o AS (SELECT prefix, id, lead(prefix) OVER (ORDER BY prefix) AS nxt FROM h), "
    "f AS (SELECT substring(prefix, 1, 2 * list_max(list_filter(range(0, least(length(prefix), length(nxt)) // 2 + 1), lambda i: substring(prefix, 1, (2 * i)::INT) = substring(nxt, 1, (2 * i)::INT)))::INT) AS prefix FROM o WHERE nxt IS NOT NULL), "
    "n AS (SELECT prefix FROM h UNION SELECT prefix FROM f UNION SELECT ''), "
    "a AS (SELECT x.prefix, y.prefix AS parent FROM n x JOIN n y ON length(y.prefix) < length(x.prefix) AND starts_with(x.prefix, y.prefix)), "
    "c AS (SELECT prefix, arg_max(parent, length(parent)) AS parent, count(*) AS depth FROM a GROUP BY prefix), k AS (SELECT parent AS prefix, count(*) AS children FROM c GROUP BY parent), "
    "t AS (SELECT n.prefix, c.parent, coalesce(c.depth, 0) AS depth, (length(n.prefix) - length(coalesce(c.parent, ''))) // 2 AS label_bytes, h.id AS terminal_id, coalesce(k.children, 0) AS children, row_number() OVER (ORDER BY n.prefix) - 1 AS node "
    "FROM n LEFT JOIN c ON c.prefix = n.prefix LEFT JOIN h ON h.prefix = n.prefix LEFT JOIN k ON k.prefix = n.prefix) "
)
NODES = D + NODES_OF_D


@registered("trie_nodes", NODES + "SELECT * FROM t")
def trie_nodes(spark, sf):
    return trie.trie_nodes(d_rows(spark, sf))


@registered(
    "trie_stats",
    NODES + "SELECT count(*) AS node_count, count(parent) AS edge_count, count(terminal_id) AS terminal_count, sum(label_bytes) FILTER (parent IS NOT NULL)::BIGINT AS label_bytes, max(label_bytes) FILTER (parent IS NOT NULL) AS longest_label, "
    "avg(depth) FILTER (terminal_id IS NOT NULL) AS average_depth, max(depth) FILTER (terminal_id IS NOT NULL) AS maximum_depth, count(*) FILTER (children > 0) AS internal_count, count(*) FILTER (parent IS NOT NULL AND label_bytes > 1) AS suffix_edges, "
    "count(*) FILTER (children = 0) AS degree_0, count(*) FILTER (children = 1) AS degree_1, count(*) FILTER (children BETWEEN 2 AND 4) AS degree_2_4, count(*) FILTER (children BETWEEN 5 AND 16) AS degree_5_16, count(*) FILTER (children >= 17) AS degree_17 FROM t",
)
def trie_stats(spark, sf):
    return trie.trie_stats(trie.trie_nodes(d_rows(spark, sf)))


@registered("trie_children", NODES + "SELECT parent, substring(prefix, length(parent) + 1, 2) AS first_byte, prefix FROM t WHERE parent IS NOT NULL")
def trie_children(spark, sf):
    return trie.child_of(trie.trie_nodes(d_rows(spark, sf)))


@registered(
    "trie_parent_deltas",
    NODES + ", e AS (SELECT t.node - p.node AS delta FROM t JOIN t p ON p.prefix = t.parent), l AS (SELECT list(delta ORDER BY delta) AS v, count(*) AS n FROM e) "
    "SELECT n, list_sum(v)::BIGINT AS total, v[n] AS maximum, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2.0 AS median, v[least(n - 1, n * 90 // 100) + 1] AS p90, v[least(n - 1, n * 99 // 100) + 1] AS p99 FROM l",
)
def trie_parent_deltas(spark, sf):
    return trie.exact_percentiles(trie.number_parents(written(trie.trie_nodes(d_rows(spark, sf)), "nodes")), "delta").select("n", "total", "maximum", "median", "p90", "p99")


@registered(
    "trie_histograms",
    NODES + ", e AS (SELECT t.*, length(bin(t.node - p.node)) AS bits, CASE WHEN t.parent IS NULL THEN 0 ELSE t.label_bytes - 1 END AS b FROM t LEFT JOIN t p ON p.prefix = t.parent) SELECT "
    "count(*) FILTER (b <= 0) AS suffix_0, count(*) FILTER (b BETWEEN 1 AND 4) AS suffix_1, count(*) FILTER (b BETWEEN 5 AND 8) AS suffix_2, count(*) FILTER (b BETWEEN 9 AND 16) AS suffix_3, count(*) FILTER (b > 16) AS suffix_4, "
    "count(*) FILTER (bits <= 4) AS delta_bits_0, count(*) FILTER (bits BETWEEN 5 AND 8) AS delta_bits_1, count(*) FILTER (bits BETWEEN 9 AND 12) AS delta_bits_2, count(*) FILTER (bits BETWEEN 13 AND 16) AS delta_bits_3, count(*) FILTER (bits > 16) AS delta_bits_4, "
    "sum(label_bytes) FILTER (parent IS NOT NULL) / nullif(count(parent), 0) AS average_label, count(*) FILTER (children = 0) / count(*) AS leaf_ratio, count(*) FILTER (b > 0) / nullif(count(parent), 0) AS suffix_ratio FROM e",
)
def trie_histograms(spark, sf):
    return trie.trie_histograms(written(trie.trie_nodes(d_rows(spark, sf)), "nodes"))


@registered("trie_correlation", NODES + ", z AS (SELECT row_number() OVER (ORDER BY prefix) - 1 AS x, terminal_id AS y FROM t WHERE terminal_id IS NOT NULL) SELECT round(coalesce(corr(x, y), 0.0), 9)::DOUBLE AS correlation FROM z")
def trie_correlation(spark, sf):
    return trie.order_correlation(written(trie.trie_nodes(d_rows(spark, sf)), "nodes")).select(F.round("correlation", 9).alias("correlation"))


@registered("trie_url_nodes", "WITH RECURSIVE d AS (SELECT page_id AS id, url AS s FROM pages) " + NODES_OF_D + "SELECT * FROM t")
def trie_url_nodes(spark, sf):
    """Pages may share a url: a row for each of them."""
    return trie.trie_entries(du_rows(spark, sf))


@registered("trie_child_offsets", NODES + "SELECT node, CASE WHEN children > 0 THEN (sum(children) OVER (ORDER BY node) - children)::BIGINT ELSE -1 END AS first_child FROM t")
def trie_child_offsets(spark, sf):
    return trie.child_offsets(written(trie.trie_nodes(d_rows(spark, sf)), "nodes"))


@registered(
    "trie_suffix_ranges",
    NODES + ", b AS (SELECT node, (CASE WHEN parent IS NULL THEN 0 ELSE label_bytes - 1 END)::BIGINT AS k FROM t), s AS (SELECT node, k, (sum(k) OVER (ORDER BY node))::BIGINT AS past, (SELECT 4 * count(*) FILTER (k > 0) <= count(*) FROM b) AS sparse FROM b) "
    "SELECT node, CASE WHEN sparse AND k = 0 THEN 0 ELSE past - k END AS first, CASE WHEN sparse AND k = 0 THEN 0 ELSE past END AS past FROM s",
)
def trie_suffix_ranges(spark, sf):
    return trie.suffix_ranges(written(trie.trie_nodes(d_rows(spark, sf)), "nodes"))


WIDTHS = ", we AS (SELECT t.node // 256 AS block, coalesce(t.node - p.node, 0) AS delta FROM t LEFT JOIN t p ON p.prefix = t.parent), pw AS (SELECT block, max(CASE WHEN delta > 0 THEN length(bin(delta)) ELSE 0 END) AS width, count(*) AS n FROM we GROUP BY block) "


@registered("trie_parent_widths", NODES + WIDTHS + "SELECT block, width, (n * width + 63) // 64 AS words FROM pw")
def trie_parent_widths(spark, sf):
    return trie.parent_widths(written(trie.trie_nodes(d_rows(spark, sf)), "nodes"))


#: The text as three hexadecimal digits a symbol, so that a suffix is a substring and sorts like the symbols.
TEXT = (
    D + ", b AS (SELECT id, hex(encode(s)) AS h FROM d), c AS (SELECT id, list_reduce(list_transform(range(0, length(h) // 2), lambda i: lpad(printf('%x', (('0x' || substring(h, (2 * i + 1)::INT, 2))::INT + 1)), 3, '0')), lambda x, y: x || y) AS t FROM b), "
    "w AS (SELECT string_agg('101' || t, '' ORDER BY id) || '101000' AS t FROM c), p AS (SELECT unnest(range(0, length(t) // 3)) AS pos, t FROM w), "
    "a AS (SELECT row_number() OVER (ORDER BY substring(t, (3 * pos + 1)::INT)) - 1 AS \"row\", pos, t FROM p), "
    "u AS (SELECT \"row\", pos, ('0x' || substring(t, (3 * ((pos + length(t) // 3 - 1) % (length(t) // 3)) + 1)::INT, 3))::INT AS sym FROM a) "
)


def d_text(spark, sf) -> DataFrame:
    return written(suffix.text_symbols(d_rows(spark, sf)), "text")


def d_bwt(spark, sf) -> DataFrame:
    text = d_text(spark, sf)
    return written(suffix.bwt(text, suffix.suffix_array(text)), "bwt")


@registered("text_suffix_array", TEXT + 'SELECT "row", pos FROM u')
def text_suffix_array(spark, sf):
    return suffix.suffix_array(d_text(spark, sf))


@registered("text_bwt", TEXT + 'SELECT "row", sym FROM u')
def text_bwt(spark, sf):
    return d_bwt(spark, sf)


@registered("text_c_table", TEXT + "SELECT sym, count(*) AS n, (sum(count(*)) OVER (ORDER BY sym) - count(*))::BIGINT AS start FROM u GROUP BY sym")
def text_c_table(spark, sf):
    return suffix.symbol_starts(d_text(spark, sf))


@registered("text_lf", TEXT + 'SELECT "row", sym, row_number() OVER (ORDER BY sym, "row") - 1 AS lf FROM u')
def text_lf(spark, sf):
    return suffix.last_to_first(d_bwt(spark, sf))


BWT_RUNS = TEXT + ', x AS (SELECT "row", sym, CASE WHEN lag(sym) OVER (ORDER BY "row") = sym THEN 0 ELSE 1 END AS s FROM u), g AS (SELECT "row", sym, sum(s) OVER (ORDER BY "row") AS g FROM x) '


@registered("text_bwt_runs", BWT_RUNS + 'SELECT (g - 1)::BIGINT AS run, any_value(sym) AS sym, min("row") AS first, max("row") + 1 AS past FROM g GROUP BY g')
def text_bwt_runs(spark, sf):
    return suffix.symbol_runs(d_bwt(spark, sf).withColumnRenamed("row", "pos"))


@registered(
    "text_run_stats",
    BWT_RUNS + ', l AS (SELECT count(*) AS k FROM g GROUP BY g) SELECT sum(k)::BIGINT AS n, count(*) AS runs, count(*) / sum(k) AS run_ratio, sum(k) / count(*) AS average_run, max(k) AS longest_run FROM l',
)
def text_run_stats(spark, sf):
    return suffix.run_statistics(d_bwt(spark, sf))


SIZES = (0, 1, 512, 513, 8192, 8193, 65_537, 1_048_576, 16_777_216, 67_108_864, 268_435_457, 2_147_483_649, 8_589_934_592)


def bit_bytes_sql(n: str) -> str:
    """Bytes of a bit vector, by level; the eighth is one node."""
    c = lambda x, y: f"(({x} + {y} - 1) // {y})"
    blocks = (512, 8192, 65536, 524288, 4194304, 33554432, 268435456)
    parts = [f"CASE WHEN {n} > 2147483648 THEN 1 ELSE 0 END"] + [f"CASE WHEN {n} > {size} THEN {c(c(n, size), 16 if k == 0 else 8)} ELSE 0 END" for k, size in enumerate(blocks)]
    return f"({c(c(n, 64), 8)} * 64 + 32 * ({' + '.join(parts)}))"


@registered("storage_estimates", f"SELECT n::BIGINT AS n, {bit_bytes_sql('n')}::BIGINT AS bit_bytes, (9 * {bit_bytes_sql('n')} + 72)::BIGINT AS wavelet_bytes, (n // 64 * 7 + ((n % 64) * 7 + 63) // 64)::BIGINT AS packed_words FROM (VALUES {', '.join(f'({n}::BIGINT)' for n in SIZES)}) t(n)")
def storage_estimates(spark, sf):
    rows = [(n, storage.bit_vector_bytes(n), storage.wavelet_bytes(n), storage.packed_words(n, 7)) for n in SIZES]
    return spark.createDataFrame(rows, "n long, bit_bytes long, wavelet_bytes long, packed_words long")


HYBRID_SQL = f"({bit_bytes_sql('n')} + 4 * ((n + 31) // 32 * 8 + (n + 4095) // 4096 * 64 + 8 * (SELECT max(s + (n - s) // 2048) FROM (VALUES (1), (2), (3), (4)) k(s))) + 136)"
RLE_SQL = f"(2 * runs + {bit_bytes_sql('n')} + 9 * {bit_bytes_sql('runs')} + 72 + 1036 + 4 * (runs + 258))"


@registered(
    "fm_backend_choice",
    BWT_RUNS + f", z AS (SELECT count(*) AS n, max(g)::BIGINT AS runs FROM g), e AS (SELECT n, runs, {HYBRID_SQL}::BIGINT AS hybrid_bytes, {RLE_SQL}::BIGINT AS run_length_bytes FROM z) "
    "SELECT n, runs, hybrid_bytes, run_length_bytes, CASE WHEN run_length_bytes * 100 <= hybrid_bytes * 85 AND runs * 5 <= n THEN 'run-length' ELSE 'hybrid' END AS backend FROM e",
)
def fm_backend_choice(spark, sf):
    transformed = d_bwt(spark, sf)
    n, runs = transformed.count(), suffix.symbol_runs(transformed.withColumnRenamed("row", "pos")).count()
    return spark.createDataFrame([(n, runs, storage.hybrid_bytes(n), storage.run_length_bytes(n, runs), storage.backend_choice(n, runs))], "n long, runs long, hybrid_bytes long, run_length_bytes long, backend string")


def width_sql(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN length(bin(({x})::BIGINT)) ELSE 0 END)"


def packed_sql(n: str, largest: str) -> str:
    return f"(8 * (({n}) // 64 * {width_sql(largest)} + (({n}) % 64 * {width_sql(largest)} + 63) // 64))"


TRIE_BYTES = (
    WIDTHS + ", tc AS (SELECT count(*) AS n, count(parent) AS edges, count(terminal_id) AS terminals, count(*) FILTER (children > 0) AS inner_n, count(*) FILTER (children >= 17) AS high, max(children) AS most, "
    "coalesce(sum(label_bytes - 1) FILTER (parent IS NOT NULL), 0)::BIGINT AS suffix_bytes, count(*) FILTER (parent IS NOT NULL AND label_bytes > 1) AS suffix_edges, (SELECT count(*) FROM d) AS strings, (SELECT sum((n * width + 63) // 64) FROM pw)::BIGINT AS words FROM t), "
    f"tb AS (SELECT strings, (n + 255) // 256 + 4 * ((n + 255) // 256 + 1) + 8 * words AS topology, n AS edge_first, suffix_bytes AS edge_suffix, "
    f"CASE WHEN 4 * suffix_edges <= n THEN {bit_bytes_sql('n')} + {packed_sql('suffix_edges + 1', 'suffix_bytes')} ELSE {packed_sql('n + 1', 'suffix_bytes')} END AS edge_boundary, {bit_bytes_sql('n')} AS terminal_bits, "
    f"{packed_sql('terminals', 'strings')} AS terminal_ids, {packed_sql('strings', 'n - 1')} AS id_to_terminal, "
    f"{bit_bytes_sql('n')} + {packed_sql('inner_n', 'edges')} + {packed_sql('inner_n', 'most')} + {packed_sql('edges', 'n - 1')} + {packed_sql('inner_n', 'high')} + 32 * high AS child_navigation, 2 * {packed_sql('inner_n', 'terminals')} AS terminal_range FROM tc) "
)
TRIE_PARTS = ("topology", "edge_first", "edge_suffix", "edge_boundary", "terminal_bits", "terminal_ids", "id_to_terminal", "child_navigation", "terminal_range")


@registered("trie_usage", NODES + TRIE_BYTES + "SELECT part, bytes::BIGINT AS bytes FROM (UNPIVOT (SELECT " + ", ".join(f"{p}::BIGINT AS {p}" for p in TRIE_PARTS) + ", (" + " + ".join(TRIE_PARTS) + ")::BIGINT AS total FROM tb) ON COLUMNS(*) INTO NAME part VALUE bytes)")
def trie_usage(spark, sf):
    strings = d_rows(spark, sf)
    found = usage.trie_usage(written(trie.trie_nodes(strings), "nodes"), strings.count())
    return spark.createDataFrame(list(found.items()), "part string, bytes long")


#: Bytes of a four-symbol column by the counts of its symbols, as a struct's parts.
def quad_sql(table: str, digit: str) -> str:
    return (
        f"(SELECT count(*) AS n, {', '.join(f'count(*) FILTER ({digit} = {s}) AS c{s}' for s in range(4))} FROM {table})"
    )


def quad_parts(alias: str = "") -> str:
    return f"(({alias}n + 31) // 32 * 8) AS raw, (64 * (({alias}n + 4095) // 4096)) AS rank, (4 * ({' + '.join(f'({alias}c{s} + 1023) // 1024' for s in range(4))})) AS select_"


@registered(
    "storage_usage",
    NODES + TRIE_BYTES + TEXT.removeprefix(D).replace(", b AS (", ", bb AS (").replace("FROM b)", "FROM bb)").replace(", c AS (", ", cc AS (").replace("FROM c)", "FROM cc)").replace(", a AS (", ", aa AS (").replace("FROM a)", "FROM aa)").replace(", p AS (", ", pp AS (").replace("FROM p)", "FROM pp)")
    + ', x AS (SELECT "row", sym, CASE WHEN lag(sym) OVER (ORDER BY "row") = sym THEN 0 ELSE 1 END AS s FROM u), z AS (SELECT count(*) AS n, sum(s)::BIGINT AS runs FROM x), '
    + "q AS (" + " UNION ALL ".join(f"SELECT {quad_parts()} FROM {quad_sql('u', f'((sym >> {k}) & 3)')}" for k in (6, 4, 2, 0)) + "), "
    + f"ze AS (SELECT n, runs, {HYBRID_SQL}::BIGINT AS hybrid_bytes, {RLE_SQL}::BIGINT AS run_length_bytes, {bit_bytes_sql('n')} + (SELECT sum(raw + rank + select_) FROM q)::BIGINT + 136 AS hybrid_actual, "
    + f"{packed_sql('258', 'n')} AS c_table, {bit_bytes_sql('n')} AS boundary, 9 * {bit_bytes_sql('runs')} + 72 AS run_index FROM z), "
    + "zf AS (SELECT *, run_length_bytes * 100 <= hybrid_bytes * 85 AND runs * 5 <= n AS rl FROM ze), "
    + f"zg AS (SELECT ({' + '.join(TRIE_PARTS)})::BIGINT AS trie, c_table::BIGINT AS c_table, ({packed_sql('strings + 1', 'strings')} + {packed_sql('strings', 'strings')})::BIGINT AS anchors, CASE WHEN rl THEN 2 * runs ELSE 0 END::BIGINT AS run_symbols, "
    + "CASE WHEN rl THEN boundary ELSE 0 END::BIGINT AS run_boundaries, CASE WHEN rl THEN 4 * (runs + 258) + 1036 ELSE 0 END::BIGINT AS run_prefixes, CASE WHEN rl THEN run_index ELSE hybrid_actual END::BIGINT AS bwt FROM tb, zf) "
    + "SELECT part, bytes FROM (UNPIVOT (SELECT *, c_table + anchors + run_symbols + run_boundaries + run_prefixes + bwt AS fm_total, trie + c_table + anchors + run_symbols + run_boundaries + run_prefixes + bwt AS total FROM zg) ON COLUMNS(*) INTO NAME part VALUE bytes)",
)
def storage_usage(spark, sf):
    return spark.createDataFrame(list(dictionary(spark, sf).memory_usage().items()), "part string, bytes long")


@registered(
    "quad_bytes",
    f"WITH v AS (SELECT 'symbols' AS of, 0 AS level, {quad_parts()} FROM {quad_sql('events', 'user_id % 4')} UNION ALL "
    + " UNION ALL ".join(f"SELECT 'level', {k}, {quad_parts()} FROM {quad_sql('events', f'((user_id >> {k}) & 3)')} WHERE {k} < (SELECT length(bin(max(user_id))) FROM events)" for k in range(0, 64, 2))
    + ") SELECT of, level::INT AS level, raw::BIGINT AS raw, rank::BIGINT AS rank, select_::BIGINT AS select_bytes, (rank + select_)::BIGINT AS auxiliary, (raw + rank + select_)::BIGINT AS allocated FROM v",
)
def quad_bytes(spark, sf):
    """Of the four-symbol column, and of every base-4 level of the users' table."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("value"))
    shifts = tuple(range(0, bit_width(events.agg(F.max("value")).first()[0] or 0), 2))
    found = [("symbols", 0, usage.level_symbol_counts(events.withColumn("value", F.col("value") % 4), (0,))[0])]
    found += [("level", k, c) for k, c in zip(shifts, usage.level_symbol_counts(events, shifts), strict=True)]
    rows = [(of, k, b["raw"], b["rank"], b["select"], b["auxiliary"], b["allocated"]) for of, k, c in found for b in [storage.quad_bytes(c)]]
    return spark.createDataFrame(rows, "of string, level int, raw long, rank long, select_bytes long, auxiliary long, allocated long")
