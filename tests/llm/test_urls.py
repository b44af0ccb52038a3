"""Hosts, paths and rules against plain Python; verdicts of the tree on planted hosts."""

import re

import pytest

from seqlytics.llm import urls

CASES = [
    "https://Example.ORG/es/1?x#y", "http://a.example.org/en/12", "http://example.org/en/2", "https://b.com/fr/", "https://b.com/de/x", "ftp://com/fr/9", "http://xcom/fr/", "no scheme", "", "://", "http://org", "http://org/",
    "http://a.org?/x", "http://u@h.org:80/p/q", "http://a//b", "x://y://z/w", "http://ÄÖ.org/ß", "http://notexample.org/es/",
]


def expected(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    rows = [(i, u) for i, u in enumerate([*CASES, None])]
    got = {r["key"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for i, u in rows:
        host, path, rule, verdict = expected(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or "allow"), u


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://mixed.net/good/{i}") for i in range(60)] + [(100 + i, f"http://www.casino-x.net/play/{i}") for i in range(60)]
    rules = (("block", "mixed.net", "/bad/1"),)
    rows += [(200 + i, f"http://mixed.net/bad/{i}") for i in range(100, 160)]
    got = {r["key"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert all(got[i] == "allow" for i in range(60))
    assert all(got[100 + i] == "block" for i in range(60))
    assert all(got[200 + i] == "block" for i in range(100, 160))


def judged(spark, rows, **how):
    return {r["key"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), **how).collect()}


def test_branches_below_the_third_segment(spark):
    """Four segments and more: the fourth decides, and purity overrules the host."""
    rows = [(i, f"http://h.net/a/b/c/good/{i}/x") for i in range(50)] + [(100 + i, f"http://h.net/a/b/c/bad/{i}/x") for i in range(50)]
    rules = (("block", "h.net", "/a/b/c/bad/1"), ("allow", "h.net", "/a/b/c/good/1"), ("allow", "h.net", "/a/b/c/good/2"), ("allow", "h.net", "/a/b/c/good/3"))
    got = judged(spark, rows, rules=rules)
    assert {got[i]["verdict"] for i in range(50)} == {"allow"} and {got[100 + i]["verdict"] for i in range(50)} == {"block"}
    assert len({got[i]["template"] for i in range(50)}) == 1 and got[0]["template"] != got[100]["template"]
    assert got[105]["rule"] is None and got[105]["template"] == "/a/b/c/bad/<n>/x"


def test_purity_overrules_the_host(spark):
    """Most labels of the host say block; a template whose labels say allow is allowed, unlabelled pages too."""
    rows = [(i, f"http://casino.net/{w}/{i}") for i, w in enumerate(["play"] * 200)] + [(1000 + i, f"http://casino.net/terms/p{i}") for i in range(60)]
    got = judged(spark, rows, rules=(("allow", "casino.net", "/terms/p1"), ("allow", "casino.net", "/terms/p2"), ("allow", "casino.net", "/terms/p3")), block_words=("casino",))
    assert got[5]["verdict"] == "block"
    assert urls.BLOCK_WORDS and got[1010]["verdict"] == "allow" and got[1010]["rule"] is not None
    rows = [(i, f"http://shop.net/list/casino{i % 3}-casino/{i}") for i in range(100)] + [(1000 + i, f"http://shop.net/help/wiki/q{i}") for i in range(100)]
    got = judged(spark, rows, rules=())
    assert got[5]["verdict"] == "block" and got[1005]["verdict"] == "allow"


def test_unlabelled_pages_share_the_verdict_of_their_template(spark):
    """Nine of ten labelled pages of a template are blocked; the unlabelled ones among them go with them. A branch without any label does not."""
    rows = [(i, f"http://s.net/item/chair{'abcdefghij'[i % 10]}/casino") if i % 3 else (i, f"http://s.net/item/k{'abcdefghij'[i % 10]}{'qrstuvw'[i % 7]}/z") for i in range(90)]
    rows += [(500 + i, f"http://s.net/about/{'abcdefghij'[i % 10]}") for i in range(90)]
    got = judged(spark, rows, rules=(), support=40)
    assert {got[i]["verdict"] for i in range(0, 90, 3)} == {"block"}
    assert {got[500 + i]["verdict"] for i in range(90)} == {"allow"}


def test_long_and_equal_paths(spark):
    deep = "/".join(["x"] * 3000)
    rows = [(1, f"http://a.net/{deep}"), (2, f"http://a.net/{deep}/y"), (3, f"http://a.net/{deep}"), (None, "http://a.net/"), (5, None), (6, f"http://a.net/{deep}/wiki"), (7, f"http://a.net/{deep}/casino")]
    got = judged(spark, rows, support=2)
    assert len(got) == 7 and all(r["verdict"] == "allow" for r in got.values())
    assert got[1]["template"].endswith("/<end>") and got[2]["template"].endswith("/*") and got[1]["template"].count("/x") == 2998  # the paths of one segment, and of none, took two wildcards


@pytest.mark.parametrize(("segment", "shown"), [("12.html", "<n>.html"), ("2024-05-01", "<date>"), ("deadbeef01", "<hex>"), ("news", "news"), ("a1b2c3d4-0000-1111-2222-333344445555", "<uuid>")])
def test_segment_classes(spark, segment, shown):
    df = spark.createDataFrame([(segment,)], "s string")
    assert df.select(urls.segment_class(df["s"])).first()[0] == shown


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "h", 1)], "page_id long, url string, host string, s1 int")
    assert urls.judge_urls(df).first()["host"] == "a.org"
    assert urls.judge_urls(df.limit(0)).collect() == []
