"""Legacy archive converter: pages are kept as ARC files (versions 1 and 2), which are turned into WARC and read back.

An ARC file is a version block and records of one header line and as many bytes as that line declares. Version 1 lines
have 5 fields, version 2 lines 10; the length is the last of either, and as an address may hold blanks, fields are split
from the right. The converter makes up what WARC needs besides: record ids (name-based UUIDs, the same in every run), ISO
dates from 14 digits, record types (response for HTTP, resource for anything else, as dns: lines) and SHA-1 digests of payload and block. Records with equal payloads become one response
(smallest page id) and revisits that refer to it.

Files are written by Spark's text writer, whose line separator is the gap that either format has between records, and are
read by Spark's binary reader, so any store that Spark reaches will do. A file holds one partition, so its size is bounded
by spark.sql.files.maxPartitionBytes.

Defined cases: null html is an empty payload; a null url is written as unknown:; blanks, controls and non-ASCII in a url are percent-encoded;
a null page id stays null and counts as larger than all others; rows that repeat an id and payload are a response and
revisits of it; a record shorter than its declared length, or a header line
with too few fields, raises ValueError; an HTTP head may lack any header; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
DATE = "20200101000000"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://barloom.invalid/warc")
WARC_GAP = "\r\n\r\n"
BATCH_BYTES = 8 << 20
INDEX = "archive string, record_no long, page_id long, payload_bytes long, payload_digest string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES from (bytes, row)."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


VALUE = pa.schema([("value", pa.binary())])


# -- ARC


def arc_header(version: int, url: str, length: int, kind: str = "text/html", date: str = DATE, ip: str = "0.0.0.0", name: str = "-") -> bytes:
    middle = ["200", "-", "-", "0", name] if version == 2 else []
    return " ".join([url, ip, date, kind, *middle, str(length)]).encode()


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 barloom\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(1, f"filedesc://{name}", len(body), "text/plain") + b"\n" + body


def http_block(page_id: int | None, payload: bytes) -> bytes:
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_writer(version: int | None) -> object:
    """Batches of (page_id, url, html) to batches of ARC records; without a version, even partitions are version 1, odd ones 2."""

    def write(it):
        part = TaskContext.get().partitionId()
        v, name = version or 1 + part % 2, f"part-{part:05d}.arc"

        def rows():
            first = True
            for batch in it:
                for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                    if first:
                        first = False
                        block = arc_version_block(v, name)
                        yield len(block), (block,)
                    payload = (html.as_buffer().to_pybytes() if html.is_valid else b"")
                    body = http_block(page_id.as_py(), payload)
                    uri = quote(url.as_py() or "unknown:", safe="%/:?#[]@!$&'()*+,;=-._~")
                    record = arc_header(v, uri, len(body), name=name) + b"\n" + body
                    yield len(record), (record,)

        yield from batches(rows(), VALUE)

    return write


def read_arc(stream) -> Iterator[tuple[int, list[str], bytes]]:
    """(record number, fields by name order of the version, block) of each record after the version block."""
    version, n = 1, 0
    while line := stream.readline():
        if not line.strip():
            continue
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        is_desc = text.startswith("filedesc://")
        most = 4 if is_desc or version == 1 else 9
        fields = text.rsplit(" ", most)
        if len(fields) <= most or not fields[-1].isdigit():
            raise ValueError(f"ARC header line without a length: {text[:200]!r}")
        block = stream.read(int(fields[-1]))
        if len(block) != int(fields[-1]):
            raise ValueError(f"ARC record of {len(block)} bytes, {fields[-1]} declared: {text[:200]!r}")
        if is_desc:
            version = int(block.split(b" ", 1)[0])
            continue
        yield n, fields, block
        n += 1


def opened(content: bytes):
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def parted(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """HTTP head with its blank line, its headers in lower case, payload; a block that isn't HTTP is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    head, gap, payload = block.partition(b"\r\n\r\n")
    headers = dict(x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return head + gap, {k.strip().lower(): v.strip() for k, v in headers.items()}, payload


def page_of(headers: dict[str, str]) -> int | None:
    return int(headers["x-page-id"]) if "x-page-id" in headers else None


def archive_name(path: str) -> str:
    """The part of a file name that is the same in every run: of our own files the partition, of others all."""
    name = path.rsplit("/", 1)[-1]
    return found[0] if (found := re.match(r"part-\d+", name)) else name


def index_arcs(it):
    schema = pa.schema([("archive", pa.string()), ("record_no", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def rows():
        for batch in it:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = archive_name(path.as_py())
                for n, _, block in read_arc(opened(content.as_buffer())):
                    _, headers, payload = parted(block)
                    yield 100, (name, n, page_of(headers), len(payload), digest(payload))

    yield from batches(rows(), schema)


# -- WARC


def record_id(archive: str, record_no: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}#{record_no}')}>"


def iso_date(fourteen: str) -> str:
    d = (fourteen + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **fields, "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block


def convert_arcs(it):
    """Batches of (path, content, revisits[(record_no, refers_page, refers_archive, refers_no)]) to WARC records."""

    def rows():
        for batch in it:
            for path, content, revisits in zip(batch.column("path"), batch.column("content"), batch.column("revisits"), strict=True):
                name = archive_name(path.as_py())
                refers = {x["record_no"]: x for x in revisits.as_py() or ()}
                info = warc_record("warcinfo", {"WARC-Record-ID": record_id(name, -1), "WARC-Date": iso_date(DATE), "Content-Type": "application/warc-fields"}, f"software: barloom\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode())
                yield len(info), (info,)
                for n, arc, block in read_arc(opened(content.as_buffer())):
                    head, _, payload = parted(block)
                    fields = {
                        "WARC-Record-ID": record_id(name, n),
                        "WARC-Date": iso_date(arc[2]),
                        "WARC-Target-URI": arc[0],
                        "WARC-IP-Address": arc[1],
                        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
                        "Content-Type": "application/http; msgtype=response" if head else arc[3],
                        "X-Payload-Length": str(len(payload)),
                    }
                    kind = "response" if head else "resource"
                    if to := refers.get(n):
                        kind, block = "revisit", head
                        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(to["archive"], to["to_no"])}
                        if to["to_page"] != common.NULL_ID:
                            fields["X-Refers-To-Page-Id"] = str(to["to_page"])
                    record = warc_record(kind, fields, block)
                    yield len(record), (record,)

    yield from batches(rows(), VALUE)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()) and line.strip():
            k, _, v = line.rstrip(b"\r\n").decode("utf-8", "replace").partition(": ")
            headers[k.lower()] = v
        block = stream.read(n := int(headers["content-length"]))
        if len(block) != n:
            raise ValueError(f"WARC record of {len(block)} bytes, {n} declared")
        yield headers, block


def read_warcs(it):
    types = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in RESULT.split(", ")])

    def rows():
        for batch in it:
            for content in batch.column("content"):
                for headers, block in read_warc(opened(content.as_buffer())):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    _, http, payload = parted(block)
                    said = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(headers["x-payload-length"])
                    if kind != "revisit" and (digest(payload) != said or len(payload) != size):
                        raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
                    to = headers.get("x-refers-to-page-id")
                    yield 200, (page_of(http), size, said, kind, int(to) if to else None, headers["warc-record-id"], headers["warc-target-uri"])

    yield from batches(rows(), schema)


# -- Spark


def _written(records: DataFrame, gap: str, what: str) -> str:
    path = common.new_path(records.sparkSession, what)
    text = records.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", gap).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    common.drop_at_exit(records.sparkSession, path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")  # names that begin with _ or . are passed over


def write_arc(pages: DataFrame, version: int | None = None) -> str:
    """Folder of ARC files with a record per page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return _written(rows.mapInArrow(arc_writer(version), "value binary"), "\n", "arc")


def arc_to_warc(spark: SparkSession, arc: str, min_bytes: int = 0) -> str:
    """Folder of WARC files from a folder of ARC files."""
    index = common.materialise(_files(spark, arc).mapInArrow(index_arcs, INDEX), "arc-index")
    able = index.where(F.col("payload_bytes") >= min_bytes).withColumn("page", common.id_key("page_id"))
    firsts = able.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct("page", "archive", "record_no")).alias("to"), F.count("*").alias("n")).where("n > 1")
    mine = F.struct("page", "archive", "record_no")
    revisits = (
        able.join(firsts, ["payload_digest", "payload_bytes"])
        .where(mine != F.col("to"))
        .groupBy(F.col("archive").alias("of"))  # a file's records: bounded as the file is
        .agg(F.collect_list(F.struct("record_no", F.col("to.page").alias("to_page"), F.col("to.archive").alias("archive"), F.col("to.record_no").alias("to_no"))).alias("revisits"))
    )
    revisits = common.materialise(revisits, "arc-revisits")
    name = F.element_at(F.split("path", "/"), -1)
    ours = F.regexp_extract(name, r"^part-\d+", 0)
    files = _files(spark, arc).withColumn("of", F.when(ours != "", ours).otherwise(name))
    return _written(files.join(revisits, "of", "left").select("path", "content", "revisits").mapInArrow(convert_arcs, "value binary"), WARC_GAP, "warc")


def warc_rows(spark: SparkSession, warc: str) -> DataFrame:
    return _files(spark, warc).mapInArrow(read_warcs, RESULT)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    return warc_rows(spark, arc_to_warc(spark, write_arc(pages), min_bytes))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (g * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * k)::INT) & 31) + 1)::INT, 1)), 'string_agg', '')),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
