"""WARC archives and revisit resolution.

Archives are gzip members, one a record, in files of bounded size.  To resolve revisits the headers alone are shuffled
by payload digest; each digest's original is found by a grouped maximum, the records that repeat it are joined to it,
and each archive is written anew by one task, with fresh headers and with revisit records for the repeated payloads.
Payloads are never shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fsio
from .common import bounded_batches, new_path, stage, table

#: Least payload that is worth a revisit record; compressed bytes after which an archive is closed.
MIN_BYTES = 1000
ROLL_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 1
FIELDS = "file string, nth long, page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, date: str, record_id: str, original: dict | None = None) -> bytes:
    """A record as a gzip member.  original: of a revisit, the page_id, url, date and record_id of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if original else http + payload
    clean = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "revisit" if original else "response"), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", clean(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if original:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{original['record_id']}>"), ("WARC-Refers-To-Date", original["date"]), ("X-Refers-To-Page-ID", str(original["page_id"]))]
        if original["url"] is not None:
            head.append(("WARC-Refers-To-Target-URI", clean(original["url"])))
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode() + block + b"\r\n\r\n") + squeeze.flush()


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of an archive, one record in memory at a time."""
    with fsio.source(uri) as f:
        rest, data = b"", bytearray()
        expand = zlib.decompressobj(31)
        while chunk := rest or f.read(1 << 20):
            data += expand.decompress(chunk)
            rest = expand.unused_data
            if expand.eof:
                head, _, block = bytes(data).partition(b"\r\n\r\n")
                first, *lines = head.decode().split("\r\n")
                fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
                if not first.startswith("WARC/") or len(block) < int(fields["content-length"]):
                    raise ValueError(f"{uri}: a damaged record")
                yield fields, block[: int(fields["content-length"])]
                data, expand = bytearray(), zlib.decompressobj(31)
        if data:
            raise ValueError(f"{uri}: the last record is cut off")


def parsed(uri: str, nth: int, fields: dict[str, str], block: bytes) -> tuple:
    number = lambda x: int(x) if x is not None else None
    http = block.partition(b"\r\n\r\n")[0].decode().split("\r\n")
    size = next(int(x.partition(":")[2]) for x in http if x.lower().startswith("content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    return uri, nth, number(fields.get("x-page-id")), fields.get("warc-target-uri"), fields["warc-date"], fields["warc-record-id"][10:-1], fields["warc-type"], size, digest, number(fields.get("x-refers-to-page-id"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=NAMES)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Write a response record per row into archives under folder; returns their names, ``(file)``.

    Null html counts as empty; null ids and URLs leave out their header.  Payloads are written whole, however long; each
    row of repeated ones gets a record of its own; no rows: no archives.
    """
    date = date or now()
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), (r for b in batches for r in zip(*(c for c in b.columns), strict=True))
        k, row, done = 0, next(rows, None), []
        while row is not None:
            uri, size, nth = f"{folder}/part-{part:05d}-{k:04d}.warc.gz", 0, 0
            with fsio.output(uri) as out:
                while row is not None and size < ROLL_BYTES:
                    page, url, html = (x.as_py() for x in row)
                    payload = (html or "").encode()
                    name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{uri}#{nth}"))
                    member = record(page, url, payload, len(payload), hashlib.sha1(payload).hexdigest(), date, name)
                    out.write(member)
                    size, nth, row = size + len(member), nth + 1, next(rows, None)
            done.append(uri)
            k += 1
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col))
    return stage(rows.mapInArrow(run, "file string"), "archives")


def _spread(files: DataFrame) -> DataFrame:
    """A task for every few archives."""
    return files.repartition(min(10_000, max(1, files.count())), "file")


def read(files: DataFrame) -> DataFrame:
    """The header rows of archives: ``FIELDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                for nth, (fields, block) in enumerate(records(uri)):
                    rows.append(parsed(uri, nth, fields, block))
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return _spread(files.select("file")).mapInArrow(run, FIELDS)


def revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(file, nth, o_*)`` of the records that repeat a payload: the original is the response with the largest page_id.

    Records of that page_id all stay responses, those without a page_id too.
    """
    whole = headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    which = F.struct("page_id", "url", "date", "record_id")
    firsts = whole.groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).agg(F.max(which).alias("o"), F.count("*").alias("n")).where("n > 1")
    return whole.join(firsts, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b"))).where("page_id <> o.page_id").select("file", "nth", "o.*")


def deduplicate(files: DataFrame, folder: str, min_bytes: int = MIN_BYTES, date: str | None = None) -> DataFrame:
    """Write archives anew with revisit records and fresh headers; returns their names.

    A response keeps its record id, to which the revisits refer; its date and length fields are written anew.
    """
    date = date or now()
    found = revisits(stage(read(files), "headers"), min_bytes)
    # an archive's revisits are at most its records, and archives are bounded
    per_file = found.groupBy("file").agg(F.collect_list(F.struct("nth", "page_id", "url", "record_id")).alias("again"))
    todo = files.join(per_file, "file", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                again = {x["nth"]: x for x in row["again"] or ()}
                uri = f"{folder}/{row['file'].rpartition('/')[2]}"
                with fsio.output(uri) as out:
                    for nth, (fields, block) in enumerate(records(row["file"])):
                        _, _, page, url, _, name, kind, size, digest, to = parsed(row["file"], nth, fields, block)
                        original = {**again[nth], "date": date} if nth in again else None
                        if kind == "revisit":
                            original = {"page_id": to, "url": fields.get("warc-refers-to-target-uri"), "record_id": fields["warc-refers-to"][10:-1], "date": fields["warc-refers-to-date"]}
                        if nth in again:
                            name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{uri}#{nth}"))
                        out.write(record(page, url, block.partition(b"\r\n\r\n")[2], size, digest, date, name, original))
                yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["file"])

    return stage(_spread(todo).mapInArrow(run, "file string"), "deduplicated")


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages, resolve revisits, and read the deduplicated archives."""
    files = write(pages, new_path(spark, "warc"))
    return read(deduplicate(files, new_path(spark, "warc-deduplicated")))


def op5(spark, sf_dir: str) -> DataFrame:
    return archive(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM s)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM w
"""
