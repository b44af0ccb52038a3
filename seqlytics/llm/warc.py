"""WARC from legacy ARC archives.

``read_arc`` parses ARC 1 and 2: the version block names the fields of the header lines, each line declares
the length of what follows. ``to_warc`` synthesises the WARC/1.0 record with the same content: identifier
(UUID 5 of url, date, digest and key), ISO timestamp, type, block and payload digests. ``write_archives``
writes one gzip member for each record into the shared folder, ``read_archives`` parses the files again.

Defined results: a null html is an empty payload; a null or empty url becomes ``urn:row:KEY``, and a url may say anything,
``filedesc:`` too; of rows with equal payloads
of at least ``revisit_bytes`` bytes those with the largest key are responses, all others revisits (a null key
counts as smaller than any other; if all are null, all are responses); repeated rows give repeated records;
an empty table gives no records. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch, bounded_batches, each, scratch_path, written

#: The field names of the two versions' header lines.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
HTTP_HEAD = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Digests, keys and urls of repeated payloads that may be broadcast, some 150 bytes each.
BROADCAST_GROUPS = 200_000
RECORDS = pa.schema([("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("block_ok", pa.bool_())])


class ArcError(ValueError):
    """An archive that breaks its own declarations."""


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 seqlytics\n{' '.join(ARC_FIELDS[version])}\n".encode()
    filled = {"Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name}
    line = [filled.get(f, "") for f in ARC_FIELDS[version]]
    line[:4], line[-1] = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"], str(len(body))
    return " ".join(line).encode() + b"\n" + body + b"\n"


def quoted(url: str) -> str:
    """A url as it stands in a header line."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]-._")


def arc_record(version: int, url: str, ip: str, date: str, kind: str, block: bytes, name: str = "-") -> bytes:
    values = {"URL": quoted(url), "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of every record of an uncompressed ARC stream, the version block first."""
    fields: tuple[str, ...] = ARC_FIELDS[1]
    first = True
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if first and not values[0].startswith("filedesc://"):
            raise ArcError("an ARC file opens with a filedesc record")
        if not values[-1].isdigit():
            raise ArcError(f"a header line without a length: {values[0]}")
        content = stream.read(int(values[-1]))
        if len(content) != int(values[-1]):
            raise ArcError(f"{values[0]}: the content is shorter than declared")
        if first:
            told = content.decode("utf-8", "replace").split("\n")
            version = told[0].split(" ")[0]
            if version not in ("1", "2"):
                raise ArcError(f"unknown ARC version {version}")
            fields, first = tuple(told[1].split(" ")) if len(told) > 1 and told[1] else ARC_FIELDS[int(version)], False
            own = ARC_FIELDS[1] if len(values) == 5 else ARC_FIELDS[2]
            yield dict(zip(own, values, strict=False)), content
            continue
        if len(values) > len(fields):  # old crawlers left blanks in the url
            values = [" ".join(values[: len(values) - len(fields) + 1]), *values[len(values) - len(fields) + 1 :]]
        if len(values) != len(fields):
            raise ArcError(f"{values[0]}: {len(values)} fields, {len(fields)} declared")
        yield dict(zip(fields, values, strict=True)), content


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    """ISO 8601 from 8 to 14 digits; missing parts are the smallest."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14] if arc_date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: Any) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(map(str, parts)))}>"


def payload_of(block: bytes, kind: str) -> bytes:
    """What follows the HTTP head of a response, else the block."""
    return block.partition(b"\r\n\r\n")[2] if kind == "response" else block


def kind_of(fields: dict[str, str], content: bytes, first: bool) -> str:
    """The type of an ARC record: its version block is the first of a file, whatever urls say."""
    return "warcinfo" if first else "response" if content[:5] == b"HTTP/" else "resource"


def response_id(url: str, date: str, payload_digest: str, key: Any) -> str:
    return record_id(url, date, payload_digest, key)


def to_warc(fields: dict[str, str], content: bytes, key: Any = None, kind: str = "response", revisit_of: Any = None, original_url: str = "") -> bytes:
    """The WARC record of a ``kind`` that stands for one ARC record; as a revisit if ``revisit_of`` names the key, and ``original_url`` the url, of the record it repeats."""
    url, date = fields["URL"], warc_date(fields["Archive-date"])
    payload = payload_of(content, kind)
    digest = sha1_base32(payload)
    head = {"WARC-Type": kind, "WARC-Record-ID": response_id(url, date, digest, key), "WARC-Date": date}
    block = content
    if kind == "warcinfo":
        head |= {"WARC-Filename": url.removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}
        block = b"software: seqlytics\r\nformat: WARC File Format 1.0\r\n"
    else:
        head |= {"WARC-Target-URI": url, "WARC-IP-Address": fields["IP-address"], "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response" if kind == "response" else fields["Content-type"]}
    if revisit_of is not None:
        block = content[: len(content) - len(payload)]
        head |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Truncated": "length", "X-Payload-Length": len(payload), "X-Refers-To-Key": revisit_of}
        head |= {"WARC-Refers-To": response_id(original_url, date, digest, revisit_of), "WARC-Refers-To-Target-URI": original_url, "WARC-Refers-To-Date": date}
    if key is not None:
        head["X-Key"] = key
    head |= {"WARC-Block-Digest": sha1_base32(block), "Content-Length": len(block)}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of a WARC file with one gzip member for each record. One record is in memory at a time."""
    left = b""
    while True:
        inflate, data = zlib.decompressobj(31), bytearray()
        while not inflate.eof:
            left = left or stream.read(1 << 18)
            if not left:
                if data:
                    raise ValueError("the last WARC record is cut off")
                return
            data += inflate.decompress(left)
            left = inflate.unused_data
        head, _, rest = bytes(data).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def arc_url(key: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("urn:row:"), F.coalesce(key.cast("string"), F.lit("None"))))


def with_types(df: DataFrame, key: str, url: str, html: str, revisit_bytes: int) -> DataFrame:
    """(key, url, html, keeper, keeper_url): of the rows that repeat a payload, the largest key with it and that row's url; else null.

    Only digests of payloads that occur more than once are joined to the rows, and only if they are few enough, counted, they are broadcast; html is not shuffled then.
    """
    k, u = F.col(f"`{key}`").cast("long"), F.col(f"`{url}`")
    rows = df.select(k.alias("key"), arc_url(k, u).alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= revisit_bytes, F.unhex(F.sha1(F.col("html").cast("binary")))))
    groups = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.max(F.struct("key", "url")).alias("last"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1 AND last.key IS NOT NULL").select("digest", F.col("last.key").alias("keeper"), F.col("last.url").alias("keeper_url")), "warc-repeated")
    joined = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "digest", "left")
    repeats = ~F.col("key").eqNullSafe(F.col("keeper"))
    return joined.select("key", "url", "html", F.when(repeats, F.col("keeper")).alias("keeper"), F.when(repeats, F.col("keeper_url")).alias("keeper_url"))


def write_archives(rows: DataFrame, date: str = "19990101000000", level: int = 3) -> DataFrame:
    """Writes (key, url, html, keeper, keeper_url) as WARC files, by way of ARC, and returns a written table of their (path, records).

    Each task writes one file under a name of its own attempt and then renames it to that of its partition,
    so a repeated task replaces what a lost one left.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    folder = scratch_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        task = TaskContext.get()
        fs, at = FileSystem.from_uri(folder)
        name = f"part-{task.partitionId():06d}.warc.gz"
        own = f"{at}/.{name}.{task.taskAttemptId()}"
        n, out = 0, None
        for keys, urls, htmls, keepers, originals in each(batches, "key", "url", "html", "keeper", "keeper_url"):
            if out is None:
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(own, compression=None)
            ids, version = keys.to_pylist(), 1 + task.partitionId() % 2
            for key, url, html, keeper, original in zip(ids, urls.to_pylist(), as_bytes(htmls), keepers.to_pylist(), originals.to_pylist(), strict=True):
                arc = arc_head(version, name, date) + arc_record(version, url, "0.0.0.0", date, "text/html", HTTP_HEAD + html)
                about, (fields, content) = read_arc(io.BytesIO(arc))
                if n == 0:  # one warcinfo for a file
                    out.write(gzip.compress(to_warc(*about, kind="warcinfo"), level, mtime=0))
                told = {} if keeper is None else {"revisit_of": keeper, "original_url": quoted(original)}
                out.write(gzip.compress(to_warc(fields, content, "-" if key is None else key, kind_of(fields, content, first=False), **told), level, mtime=0))
                n += 1
        if out is not None:
            out.close()
            fs.move(own, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    return written(rows.mapInArrow(write, "path string, records long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each response and revisit in the files of (path, ...); digests of responses are of the bytes read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for (paths,) in each(batches, "path"):
            for path in paths.to_pylist():
                fs, at = FileSystem.from_uri(path)
                rows: list[dict[str, Any]] = []
                with fs.open_input_stream(at, compression=None) as stream:
                    for head, block in read_warc(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        told = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        payload = payload_of(block, "response") if head["WARC-Type"] == "response" else None
                        digest = told if payload is None else hashlib.sha1(payload).hexdigest()
                        key, refers = head["X-Key"], head.get("X-Refers-To-Key")
                        rows.append({
                            "key": None if key == "-" else int(key), "payload_bytes": int(head["X-Payload-Length"]) if payload is None else len(payload), "payload_digest": digest, "record_type": head["WARC-Type"],
                            "refers_to": None if refers is None else int(refers), "record_id": head["WARC-Record-ID"], "refers_to_id": head.get("WARC-Refers-To"), "target_uri": head["WARC-Target-URI"], "warc_date": head["WARC-Date"],
                            "block_ok": digest == told and sha1_base32(block) == head["WARC-Block-Digest"],
                        })
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, RECORDS)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORDS)

    files = archives.select("path").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4)
    return files.mapInArrow(read, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, target_uri string, warc_date string, block_ok boolean")


def archive_pages(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 1000) -> DataFrame:
    """Writes the pages as WARC archives and reads these back: one row for each page."""
    return read_archives(write_archives(with_types(df, key, url, html, revisit_bytes)))
