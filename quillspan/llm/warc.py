"""WARC archives: writing captures, reading records back, and assembling transactions.

Each page becomes a request, a response (or a revisit of an equal payload) and a metadata record.
Spark's text writer puts the records down with the two line ends that close a WARC record as its
separator, so archives go to any store by Spark's commit protocol; files are bounded by records and bytes. Reading streams each archive record
by record. Requests and metadata then join their capture through the identifiers they name as
concurrent to, and each capture is one nested row.

A null payload is empty; a null url leaves out the target; of rows that repeat page_id and payload the
first counts as the smaller; rows with a null page_id come last among equals; an empty table gives an
empty result; further columns aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, blocks, by_frames, framed, fresh_path, held, remove, saved

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of an archive file, and its bytes, at most (but for one capture's).
FILE_RECORDS, FILE_BYTES = 30_000, 500_000_000
#: Parts into which what joins a much-copied page is dealt.
SALTS = 16
RECORD_COLUMNS = "record_id string, type string, target string, concurrent_to array<string>, refers_to string, digest string, payload_bytes long, fields map<string,string>, block binary"


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode()).digest())}>"


def _record(kind: str, record_id: str, block: bytes, content: str, date: str, **more: str | None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"Content-Type: {content}"]
    head += [f"WARC-{k.replace('_', '-').title().replace('Uri', 'URI')}: {v}" for k, v in more.items() if v is not None]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _one_line(text: str | None) -> str | None:
    return None if text is None else text.strip().replace("\r", "%0D").replace("\n", "%0A")


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC headers give it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captures(df: DataFrame, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload, copy, first_id: of equal payloads the first page's id (null: no revisits)."""
    rows = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumn("hash", F.sha1("payload")).withColumn("copy", F.lit(0))
    if not df.groupBy(page_id).count().where("count > 1").isEmpty():
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "hash").orderBy("url")) - 1)
    equal = rows.where(F.octet_length("payload") >= least_bytes).groupBy("hash").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("page_id", "copy"), F.lit(SALTS)).cast("int")
    firsts = equal.where("n > 1").select("hash", "first_id", F.lit(True).alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", salt).join(firsts, ["hash", "salt"], "left").withColumn("shared", F.coalesce("shared", F.lit(False))).drop("hash", "salt")


def write_pages(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archives of all rows."""

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"record": [_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"format: WARC File Format 1.1", "application/warc-fields", date)]})
        for frame in blocks(frames, "payload"):
            out = []
            for page, target, text, copy, first, shared in frame[["page_id", "url", "payload", "copy", "first_id", "shared"]].itertuples(index=False, name=None):
                page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                payload, uri = text.encode(), _one_line(target)
                me, digest = _id("capture", page, copy), f"sha1:{payload_digest(payload)}"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                if shared and (page, copy) != (first, 0):
                    out.append(_record("revisit", me, http, "application/http; msgtype=response", date, target_uri=uri, payload_digest=digest, profile=PROFILE, refers_to=_id("capture", first, 0)))
                else:
                    out.append(_record("response", me, http + payload, "application/http; msgtype=response", date, target_uri=uri, payload_digest=digest))
                out.append(_record("request", _id("request", page, copy), f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode(), "application/http; msgtype=request", date, target_uri=uri, concurrent_to=me))
                fields = f"page-id: {'' if page is None else page}\r\ncopy: {copy}\r\n".encode()
                out.append(_record("metadata", _id("metadata", page, copy), fields, "application/warc-fields", date, target_uri=uri, concurrent_to=me))
            yield pd.DataFrame({"record": out})

    largest = df.agg(F.max(F.octet_length(html))).first()[0] or 0
    at_once = max(3, min(FILE_RECORDS, 3 * (FILE_BYTES // (largest + 4096))))
    made = by_frames(captures(df, page_id, url, html, least_bytes), records, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", at_once).text(path)


def _headers(lines: Iterator[bytes]) -> list[tuple[str, str]]:
    found = []
    for line in iter(lambda: next(lines, b"").rstrip(b"\r\n"), b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found.append((name.strip().lower(), value.strip()))
    return found


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers by lower-case name, and block, of each record; one record at a time is held."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("a record doesn't start where one should")
            continue
        head: dict[str, list[str]] = {}
        for name, value in _headers(iter(stream.readline, b"")):
            head.setdefault(name, []).append(value)
        yield head, stream.read(int(head["content-length"][0]))


def read_records(spark: SparkSession, path: str, blocks_too: bool = True) -> DataFrame:
    """A row for each record; payload_bytes and digest are those of the payload, found anew where it is there."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD_COLUMNS.split(", ")]
        for batch in batches:
            for data in batch["content"]:
                rows = []
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
                for head, block in parse_records(stream):
                    one = lambda name, head=head: head.get(name, [None])[0]
                    kind, digest, size, fields = one("warc-type"), one("warc-payload-digest"), None, None
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = dict(_headers(iter(http.split(b"\n")[1:])))
                        size, digest = (len(payload), payload_digest(payload)) if kind == "response" else (int(said.get("content-length", 0)), (digest or "").partition(":")[2])
                    elif one("content-type") == "application/warc-fields":
                        fields = dict(_headers(iter(block.splitlines(keepends=True))))
                    rows.append((one("warc-record-id"), kind, one("warc-target-uri"), head.get("warc-concurrent-to", []), one("warc-refers-to"), digest, size, fields, block if blocks_too else None))
                    if len(rows) >= 2000 or blocks_too and sum(len(r[-1]) for r in rows[-50:]) > 8_000_000:
                        yield framed(rows, names)
                        rows = []
                yield framed(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    made = by_frames(files, read, RECORD_COLUMNS)
    with arrow_rows(spark, 1):  # a row is a file
        return saved(made)


def assemble(records: DataFrame) -> DataFrame:
    """A nested row for each capture: capture (response or revisit), request, metadata (an array).

    A link may be named by either side. Records that are concurrent to no capture belong to none;
    a capture without request or metadata stays, with null and an empty array.
    """
    body = ["record_id", "type", "target", "refers_to", "digest", "payload_bytes", "fields", "block"]
    is_capture = F.col("type").isin("response", "revisit")
    main = records.where(is_capture).select("record_id", "concurrent_to", F.struct(*body).alias("capture"))
    others = records.where(F.col("type").isin("request", "metadata")).select(F.col("record_id").alias("other"), F.struct(*body).alias("record"), "concurrent_to")
    links = others.select("other", F.explode("concurrent_to").alias("record_id")).union(main.select(F.explode("concurrent_to").alias("other"), "record_id")).distinct()
    joined = links.join(others.drop("concurrent_to"), "other").groupBy("record_id").agg(
        F.min(F.when(F.col("record.type") == "request", F.struct("other", "record.target", "record.block"))).alias("request"),
        F.collect_list(F.when(F.col("record.type") == "metadata", F.struct("other", "record.fields", "record.block"))).alias("metadata"),
    )
    return main.join(joined, "record_id", "left").select("record_id", "capture", "request", F.coalesce("metadata", F.array().cast("array<struct<other:string,fields:map<string,string>,block:binary>>")).alias("metadata"))


def pages_through_archives(df: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read back from the archives."""
    path = fresh_path(df.sparkSession, "warc")
    write_pages(df, path, least_bytes=least_bytes)
    records = read_records(df.sparkSession, path, blocks_too=False)  # read once, and kept
    remove(df.sparkSession, path)
    rows = assemble(records).select(
        "record_id",
        F.expr("try_cast(metadata[0].fields['page-id'] as bigint)").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").alias("target_id"),
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = held(rows)
    first = rows.where("record_type = 'response'").select(F.col("record_id").alias("target_id"), F.col("page_id").alias("refers_to"))
    wanted = rows.where("record_type = 'revisit'").select("target_id").distinct().join(first, "target_id")
    dealt = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = rows.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).join(dealt, ["target_id", "salt"], "left")
    responses = rows.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.select(*columns).union(revisits.select(*columns))
