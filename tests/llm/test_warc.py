"""Parsing of both ARC versions, and the way through archives and back."""

import gzip
import hashlib
import io

import pytest

from seqlytics.llm import warc


def test_arc_versions():
    for version in (1, 2):
        data = warc.arc_head(version, "f.arc", "19990102030405") + warc.arc_record(version, "http://a.org/x y", "1.2.3.4", "19990102030405", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi\n\nthere") + b"\n"
        head, (fields, content) = warc.read_arc(io.BytesIO(data))
        assert head[0]["URL"] == "filedesc://f.arc"
        assert fields["URL"] == "http://a.org/x%20y" and content.endswith(b"hi\n\nthere")


def test_blank_in_a_url_is_kept():
    data = warc.arc_head(1, "f", "1999") + b"http://a.org/x y 1.2.3.4 19990101 text/html 2\nhi\n"
    assert list(warc.read_arc(io.BytesIO(data)))[1][0]["URL"] == "http://a.org/x y"


@pytest.mark.parametrize("tail", [b"http://a 1 2 3 99\nshort", b"http://a 1 2 3 x\n", b"http://a 5\nhello\n"])
def test_broken_archives(tail):
    with pytest.raises(warc.ArcError):
        list(warc.read_arc(io.BytesIO(warc.arc_head(1, "f", "1999") + tail)))
    with pytest.raises(warc.ArcError):
        list(warc.read_arc(io.BytesIO(tail)))


def test_synthesised_record():
    fields = {"URL": "http://a.org/", "IP-address": "1.2.3.4", "Archive-date": "199901", "Content-type": "text/html"}
    record = warc.to_warc(fields, b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody")
    assert record == warc.to_warc(fields, b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody")
    ((head, block),) = warc.read_warc(io.BytesIO(gzip.compress(record)))
    assert (head["WARC-Type"], head["WARC-Date"]) == ("response", "1999-01-01T00:00:00Z")
    assert head["WARC-Payload-Digest"] == warc.sha1_base32(b"body") and block.endswith(b"body")
    assert warc.kind_of(fields, b"a.org 1.2.3.4", False) == "resource" and warc.kind_of(fields, b"1 0 x", True) == "warcinfo"
    assert b"WARC-Type: resource" in warc.to_warc(fields | {"URL": "dns:a.org"}, b"a.org 1.2.3.4", kind="resource")
    with pytest.raises(ValueError):
        list(warc.read_warc(io.BytesIO(gzip.compress(record)[:-9])))


def test_pages_there_and_back(spark):
    big, other = "é" * 500, "b" * 999
    rows = [(1, "http://a", big), (2, "http://b", big), (2, "http://b", big), (3, None, None), (4, "http://c", other), (5, "http://d", other), (6, "a b\n", "<p>"), (None, "http://n", big), (7, "http://l", "z" * 300_000), (8, "filedesc://x", "<p>8"), (9, "", "filedesc"), (10, "filedesc:y z", big)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["block_ok"]) for r in warc.archive_pages(df).collect()), key=str)
    want = []
    for key, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and key != 10
        want.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 10 if revisit else None, True))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_revisits_name_their_response(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", broadcast)
    rows = [(i, f"filedesc:{i} ü", "same" * 400) for i in range(30)] + [(100 + i, None, f"{i}" * 2000) for i in range(5)]
    got = {r["key"]: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 35 and got[29]["record_type"] == "response" and got[29]["refers_to_id"] is None
    assert {r["refers_to_id"] for k, r in got.items() if k < 29} == {got[29]["record_id"]}
    assert {r["refers_to"] for k, r in got.items() if k < 29} == {29}


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
