"""Registered queries on tables that hold copies of rows under other keys, as the larger tables do, against their DuckDB counterparts."""

import duckdb
import pytest

from seqlytics.plans import catalog

URLS = ["https://blog.a/x.html", "https://blog.a/x", "https://b.org/", "http://c.de/y.html", "https://blog.a/x.html", "https://b.org/", "https://blog.a/x.html"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("copies")
    spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def both(spark, folder, name, table="pages"):
    """The query's rows and its counterpart's, with columns in one order."""
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str), sorted(want.fetchall(), key=str)


def test_prefix(spark, pages):
    got, want = both(spark, pages, "dict_prefix")
    assert got == want == [(0,), (1,), (4,), (6,)]


def test_suffix(spark, pages):
    got, want = both(spark, pages, "dict_suffix")
    assert got == want == [(0,), (3,), (4,), (6,)]


def untied(rows, columns, key, *open_columns):
    """The rows without the columns that the SQL's ORDER BY leaves open, and all values of those for each key."""
    at = [columns.index(c) for c in open_columns]
    sets = {(r[columns.index(key)], c): set() for r in rows for c in open_columns}
    for r in rows:
        for c, i in zip(open_columns, at, strict=True):
            sets[r[columns.index(key)], c].add(r[i])
    return sorted(str([x for i, x in enumerate(r) if i not in at]) for r in rows), sets


def test_trie_of_shared_urls(spark, pages):
    """A row for each page. Which of the pages of a url gets which of its numbers is open in the SQL, and goes by ids here."""
    got, want = both(spark, pages, "trie_url_nodes")
    columns = ["prefix", "parent", "depth", "label_bytes", "terminal_id", "children", "node"]
    assert untied(got, columns, "prefix", "terminal_id", "node") == untied(want, columns, "prefix", "terminal_id", "node")
    assert {r[4] for r in got} - {None} == set(range(len(URLS))) and sorted(r[6] for r in got) == list(range(len(got)))
    rows = sorted(got, key=lambda r: r[6])
    assert rows == sorted(got, key=lambda r: (r[0], -1 if r[4] is None else r[4]))
