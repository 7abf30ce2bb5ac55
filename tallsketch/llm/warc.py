"""Legacy archive converter: ARC files (versions 1 and 2) to WARC/1.0, as Spark jobs.

``write_arc`` lays records out as ARC files, ``read_arc`` parses them by the record definition
of each file's version block and the declared lengths, ``convert`` synthesises WARC identifiers,
timestamps, types and digests, and ``read_warc`` reads WARC files back.  Files go through
Spark's text writer and binary reader, so any store that Spark reaches will do and lost tasks
leave nothing behind.  A file holds at most ``RECORDS`` records; a task holds one file of
compressed bytes and one record at a time.

Equal payloads of at least ``MIN_REVISIT`` bytes are written once: the record with the largest
page id (of equals the last file and offset) is the response, the others are revisits of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm.common import join_hot, stored, table
from tallsketch.session import scratch_path, ship_package

#: Records in a file.
RECORDS = 10_000
#: Smallest payload that becomes a revisit.
MIN_REVISIT = 1000
#: Bytes of records handed to Arrow at once.
BATCH = 4 << 20

#: Fixed: field names of the two versions' record definitions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed: the profile of a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows; a batch is closed after BATCH bytes of column ``weight`` or 5000 rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight]) if weight is not None else 0
        if size >= BATCH or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


# ---- ARC ---------------------------------------------------------------------------------

def arc_record(version: int, url: str | None, date: str, block: bytes, offset: int, name: str) -> bytes:
    """One ARC record: the header line of the version and the block.  White space and control
    characters of the URL are percent-encoded, as the line is split at blanks."""
    url = "".join(quote(c) if c.isspace() or ord(c) < 33 else c for c in url or "") or "about:blank"
    if version == 1:
        line = f"{url} 0.0.0.0 {date} text/html {len(block)}"
    else:
        sha = hashlib.sha1(block).hexdigest()
        line = f"{url} 0.0.0.0 {date} text/html 200 {sha} - {offset} {name} {len(block)}"
    return line.encode() + b"\n" + block


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 tallsketch\n{ARC_FIELDS[version]}\n".encode()
    if version == 1:
        line = f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {len(body)}"
    else:
        line = f"filedesc://{name} 0.0.0.0 20000101000000 text/plain 200 - - 0 {name} {len(body)}"
    return line.encode() + b"\n" + body


def parse_arc(data) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of every record of a binary stream.

    A ``filedesc`` record sets the version for what follows it.  The declared length alone ends
    a block, whatever it holds; a broken header or a short block raises ``ValueError``."""
    fields, at = None, 0
    while True:
        line = data.readline()
        start, at = at, at + len(line)
        if not line:
            return
        if line == b"\n":
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\n").split(" ")
        if parts[0].startswith("filedesc://") or fields is None:
            length = int(parts[-1])
            block = data.read(length)
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS or not parts[0].startswith("filedesc://"):
                raise ValueError(f"no version block of a known version at offset {start}")
            fields = ARC_FIELDS[version].split(" ")
        else:
            if len(parts) != len(fields):
                raise ValueError(f"{len(parts)} fields at offset {start}, the definition has {len(fields)}")
            head = dict(zip(fields, parts))
            length = int(head["Archive-length"])
            block = data.read(length)
            if len(block) == length:
                yield start, head, block
        if len(block) != length:
            raise ValueError(f"block at offset {start} is cut off")
        at += length


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
              records: int = RECORDS) -> None:
    """Write pages as gzipped ARC files, version 1 and 2 in turn: from file to file of a task, and
    from task to task.

    Null html is an empty payload, a null url is about:blank, a null key has no page header.
    The archive date counts seconds from 2000-01-01 by key, as pages carry no time."""
    def run(batches):
        n, version, offset, name = 0, 2 - TaskContext.get().partitionId() % 2, 0, ""
        for b in batches:
            out = []
            for k, u, h in zip(*(c.to_pylist() for c in b.columns)):
                if n % records == 0:
                    version, name = 3 - version, f"part-{n // records}.arc"
                    out.append(version_block(version, name))
                    offset = len(out[-1]) + 1
                n += 1
                payload = (h or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                head += "" if k is None else f"{PAGE_HEADER}: {k}\r\n"
                out.append(arc_record(version, u, archive_date(k), head.encode() + b"\r\n" + payload, offset, name))
                offset += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # records + 1 rows a file: its version block and its records
    rows = pages.select(key, url, html).mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    _write(rows, path, "\n", records + 1)


def archive_date(key: int | None) -> str:
    """Fourteen digits: seconds from 2000-01-01 by key, within 2000 to 2009."""
    import datetime

    return (datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=(key or 0) % 315_000_000)).strftime("%Y%m%d%H%M%S")


def _write(rows: DataFrame, path: str, end: str, records: int) -> None:
    (rows.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", records).text(path))


def _open(content) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def _http(block: bytes) -> tuple[dict[str, str], int]:
    """The HTTP header fields and where the payload begins (after the blank line, if any)."""
    end = block.find(b"\r\n\r\n")
    if end < 0 or not block.startswith(b"HTTP/"):
        return {}, 0
    lines = block[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def _page(head: dict[str, str]) -> int | None:
    got = head.get(PAGE_HEADER.lower())
    return int(got) if got else None


def record_id(file: str, offset: int, url: str) -> str:
    """The identifier of a converted record: the same whenever it is converted again."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset} {url}')}"


ARC_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("url", pa.string()),
                        ("date", pa.string()), ("ip", pa.string()), ("page_id", pa.int64()),
                        ("payload_bytes", pa.int64()), ("sha1", pa.binary()), ("block", pa.binary())])
ARC_COLUMNS = ("file string, offset long, record_id string, url string, date string, ip string, page_id long, "
               "payload_bytes long, sha1 binary, block binary")


def arc_rows(path: str, content) -> Iterator[tuple]:
    """The records of one ARC file, as tuples of ARC_SCHEMA."""
    name = path.rpartition("/")[2]
    for offset, head, block in parse_arc(_open(content)):
        http, at = _http(block)
        payload = memoryview(block)[at:]
        yield (name, offset, record_id(name, offset, head["URL"]), head["URL"], head["Archive-date"],
               head["IP-address"], _page(http), len(payload), hashlib.sha1(payload).digest(), block)


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of the ARC files under ``path``; without ``blocks`` the block is empty."""
    def run(batches):
        def rows():
            for b in batches:
                for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                    for row in arc_rows(name, content.as_buffer()):
                        yield row if blocks else (*row[:-1], b"")
        return _batches(rows(), ARC_SCHEMA, 9)

    return _files(spark, path).mapInArrow(run, ARC_COLUMNS)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


# ---- WARC --------------------------------------------------------------------------------

def warc_record(kind: str, head: dict[str, str], block: bytes) -> bytes:
    """One record but for its last line end, which the writer adds."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n"


def digest32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def iso_date(date: str) -> str:
    """An ARC date (14 digits, or 12 in old files) as a WARC timestamp."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(spark: SparkSession, arc: str, warc: str, records: int = RECORDS) -> None:
    """Convert the ARC files under ``arc`` to gzipped WARC files under ``warc``.

    A file is the unit of work: the list of its revisits (at most a row per record of it) meets the
    compressed file, and its blocks go from the parser to the writer in one task."""
    ship_package(spark)
    heads = stored(read_arc(spark, arc, blocks=False).drop("block", "ip"), "arc-heads")
    large = heads.filter(F.col("payload_bytes") >= MIN_REVISIT)
    keep = (
        large.groupBy("sha1", "payload_bytes")
        .agg(F.count(F.lit(1)).alias("n"),
             F.max(F.struct("page_id", "file", "offset", "record_id", "url", "date")).alias("keep"))
        .filter("n > 1").select("sha1", "payload_bytes", "n", F.col("keep.record_id").alias("to_id"),
                                F.col("keep.url").alias("to_url"), F.col("keep.date").alias("to_date"))
    )
    revisits = (
        join_hot(large.select("sha1", "payload_bytes", "file", "offset", "record_id"), stored(keep, "arc-keep"),
                 ["sha1", "payload_bytes"], heads.count(), "n")
        .filter("record_id <> to_id")
    )
    per_file = stored(revisits.groupBy("file").agg(
        F.collect_list(F.struct("offset", "to_id", "to_url", "to_date")).alias("again")), "arc-revisits")

    def run(batches):
        info = b"software: tallsketch\r\nformat: WARC File Format 1.0\r\n"
        def rows():
            for b in batches:
                for path, content, again in zip(*(b.column(n) for n in ("path", "content", "again"))):
                    to = {x["offset"]: x for x in again.as_py() or ()}
                    first = True
                    for row in arc_rows(path.as_py(), content.as_buffer()):
                        r = dict(zip(ARC_SCHEMA.names, row))
                        if first:
                            name = record_id("warcinfo", r["offset"], r["record_id"])
                            yield (warc_record("warcinfo", {"WARC-Record-ID": f"<{name}>", "WARC-Date": iso_date(r["date"]),
                                                            "Content-Type": "application/warc-fields"}, info),)
                            first = False
                        yield (to_warc(r, to.get(r["offset"])),)
        return _batches(rows(), pa.schema([("record", pa.binary())]), 0)

    files = _files(spark, arc).withColumn("file", F.element_at(F.split("path", "/"), -1))
    rows = files.join(per_file, "file", "left").select("path", "content", "again").mapInArrow(run, "record binary")
    _write(rows.select(F.col("record").cast("string")), warc, "\r\n", records)


def to_warc(r: dict, to: dict | None) -> bytes:
    """A converted ARC record; a revisit (of ``to``) keeps the HTTP head and leaves the payload out."""
    block = r["block"]
    head = {"WARC-Record-ID": f"<{r['record_id']}>", "WARC-Date": iso_date(r["date"]), "WARC-Target-URI": r["url"],
            "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": digest32(r["sha1"])}
    if to is not None:
        block = block[: len(block) - r["payload_bytes"]]
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{to['to_id']}>",
                 "WARC-Refers-To-Target-URI": to["to_url"], "WARC-Refers-To-Date": iso_date(to["to_date"])}
    kind = "application/http; msgtype=response" if block.startswith(b"HTTP/") else "text/html"
    head |= {"WARC-Block-Digest": digest32(hashlib.sha1(block).digest()), "Content-Type": kind}
    return warc_record("response" if to is None else "revisit", head, block)


def parse_warc(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of a binary stream."""
    while line := data.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
        head = {}
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            head[k.strip().lower()] = v.strip()
        length = int(head["content-length"])
        block = data.read(length)
        if len(block) != length:
            raise ValueError("block is cut off")
        yield head, block


WARC_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
                         ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                         ("sha1", pa.binary()), ("refers_to_id", pa.string()), ("payload", pa.binary())])
WARC_COLUMNS = ("record_id string, record_type string, url string, date string, page_id long, payload_bytes long, "
                "sha1 binary, refers_to_id string, payload binary")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the WARC files under ``path``.

    Block and payload digests are checked against the bytes.  A revisit has the length and the
    digest of the full payload, from its HTTP head and its payload digest, and no payload."""
    def run(batches):
        def rows():
            for b in batches:
                for content in b.column(1):
                    for head, block in parse_warc(_open(content.as_buffer())):
                        kind = head["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        if digest32(hashlib.sha1(block).digest()) != head["warc-block-digest"]:
                            raise ValueError(f"{head['warc-record-id']}: the block differs from its digest")
                        http, at = _http(block)
                        payload = memoryview(block)[at:]
                        sha1 = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
                        if kind == "response" and hashlib.sha1(payload).digest() != sha1:
                            raise ValueError(f"{head['warc-record-id']}: the payload differs from its digest")
                        size = len(payload) if kind == "response" else int(http["content-length"])
                        yield (head["warc-record-id"].strip("<>"), kind, head["warc-target-uri"], head["warc-date"],
                               _page(http), size, sha1, head.get("warc-refers-to", "").strip("<>") or None,
                               bytes(payload) if payloads else b"")
        return _batches(rows(), WARC_SCHEMA, 8)

    ship_package(spark)
    return _files(spark, path).mapInArrow(run, WARC_COLUMNS)


def archive_digest(spark: SparkSession, pages: DataFrame, records: int = RECORDS) -> DataFrame:
    """Pages through ARC and WARC files and back: one row per page with its record's type.

    Empty input gives no rows; null and repeated page ids keep a record each."""
    ship_package(spark)
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, records=records)
    convert(spark, arc, warc, records)
    back = stored(read_warc(spark, warc, payloads=False).select(
        "record_id", "record_type", "page_id", "payload_bytes", "sha1", "refers_to_id"), "warc-heads")
    once = back.filter("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    again = back.filter("refers_to_id is not null")
    target = stored(again.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n")).join(
        back.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")), "refers_to_id"),
        "warc-targets")
    linked = join_hot(again, target, ["refers_to_id"], back.count(), "n")
    cols = ["page_id", "payload_bytes", F.lower(F.hex("sha1")).alias("payload_digest"), "record_type", "refers_to"]
    return once.select(*cols).unionByName(linked.select(*cols))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digest(spark, table(spark, sf_dir, "pages"))


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
           FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> keep THEN keep END AS refers_to FROM g
"""

QUERIES = {"op4_arc_to_warc": op4_arc_to_warc}
ORACLES = {"op4_arc_to_warc": ORACLE}
