"""WARC archives: writing, reading, and revisit records for repeated payloads.

Archives are folders of WARC/1.1 files. A file is written by Spark's text
writer, one record to a row, with the CRLF CRLF that ends a record as its line
separator; so files appear whole or not at all, in any store Spark can write
to. They are read as binary files and cut into records by Content-Length.

Revisits are resolved by shuffling headers: records meet by payload digest, the
one of least page id is the response and the others become revisit records.
Revisit records that are there already take part by the digest that they name;
one that is to be the response, or whose payload is too short for revisits, gets
its payload back from an original response. Decisions then meet the records by
record id, and a new archive is written with fresh headers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.bytesops import column, lean
from docquarry.llm.skew import join_groups
from docquarry.llm.store import keep, new_path

#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
#: The date of records where the pages have none.
DATE = "2024-01-01T00:00:00Z"
#: Records to a file, at most: a file's compressed bytes are read at once.
FILE_RECORDS = 1000
#: Payload bytes, and records, that are held as Python objects at a time.
HELD_BYTES, HELD_RECORDS = 4 << 20, 256
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def http_head(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def record(kind: str, record_id: str, page_id: int | None, url: str | None, date: str, payload_digest: str, size: int, payload: bytes = b"", refers: dict | None = None) -> bytes:
    """One record, without the CRLF CRLF that ends it. `size` is that of the full payload."""
    block = http_head(size) + payload
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = _clean(url)
    fields["WARC-Payload-Digest"] = f"sha1:{payload_digest}"
    if page_id is not None:
        fields["Page-ID"] = page_id
    if refers:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers['record_id']}>", "WARC-Refers-To-Date": refers["date"]}
        if refers["url"] is not None:
            fields["WARC-Refers-To-Target-URI"] = _clean(refers["url"])
        if refers["page_id"] is not None:
            fields["Refers-To-Page-ID"] = refers["page_id"]
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + CRLF + block


def parse(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file, read one after the other."""
    while line := file.readline():
        if line == CRLF:  # the end of the record before
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := file.readline()) not in (CRLF, b""):
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            fields[name.strip()] = value.strip()
        block = file.read(int(fields["Content-Length"]))
        if len(block) < int(fields["Content-Length"]):
            raise ValueError("a WARC record is cut short")
        yield fields, block


_HEADER = "record_type string, record_id string, page_id long, url string, date string, payload_digest string, payload_bytes long, refers_to_id string, refers_to long, refers_to_url string, refers_to_date string"
_NAMES = [f.split()[0] for f in _HEADER.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]


def _row(fields: dict[str, str], block: bytes) -> tuple[list, bytes]:
    head, _, payload = block.partition(CRLF + CRLF)
    number = lambda k: int(fields[k]) if k in fields else None
    length = re.search(rb"(?im)^Content-Length: *(\d+)", head)
    return [
        fields["WARC-Type"], fields["WARC-Record-ID"].strip("<>"), number("Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Date"],
        fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(length[1]) if length else len(payload),
        fields.get("WARC-Refers-To", "").strip("<>") or None, number("Refers-To-Page-ID"), fields.get("WARC-Refers-To-Target-URI"), fields.get("WARC-Refers-To-Date"),
    ], payload


def _read(with_payload: bool):
    def run(batches):
        rows, payloads, held = [], [], 0

        def flush():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            if with_payload:
                columns.append(pa.array(payloads, pa.binary()))
            return pa.RecordBatch.from_arrays(columns, _NAMES + ["payload"] * with_payload)

        for batch in batches:
            for content in batch.column(0):
                with gzip.GzipFile(fileobj=io.BytesIO(memoryview(content.as_buffer()))) as file:
                    for fields, block in parse(file):
                        row, payload = _row(fields, block)
                        rows.append(row)
                        if with_payload:
                            payloads.append(payload)
                            held += len(payload)
                        if len(rows) >= HELD_RECORDS or held >= HELD_BYTES:
                            yield flush()
                            rows, payloads, held = [], [], 0
        if rows:
            yield flush()

    return run


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of an archive: their headers and, if asked for, payloads (empty for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(lean(_read(with_payload)), _HEADER + ", payload binary" * with_payload)


def write_archive(records: DataFrame, path: str) -> str:
    """Write rows of one column, record (string), as an archive."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "THREE").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


def _slices(batch: pa.RecordBatch, payload: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of few rows and payload bytes: payloads are held as Python bytes, once as read and once as written."""
    total, lo = column(payload)[1][1:], 0
    while lo < batch.num_rows:
        hi = max(lo + 1, min(lo + HELD_RECORDS, int(total.searchsorted((total[lo - 1] if lo else 0) + HELD_BYTES, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _responses(batches):
    """(page_id, url, html, date) -> a response record of each."""
    for batch in batches:
        for part in _slices(batch, batch.column(2)):
            out = []
            columns = part.column(0), part.column(1), part.column(2).cast(pa.binary()), part.column(3)
            for page_id, url, html, date in zip(*(c.to_pylist() for c in columns), strict=True):
                payload = html or b""
                out.append(record("response", uuid.uuid4().urn, page_id, url, date, digest(payload), len(payload), payload))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])


def fresh_id(record_id: str) -> str:
    """A record's id in the archive that is made from its own."""
    return uuid.uuid5(uuid.NAMESPACE_URL, record_id).urn


def _renewed(batches):
    """(header columns, payload, first) -> the record with fresh headers; a revisit if it has another to refer to."""
    for batch in batches:
        for part in _slices(batch, batch.column(batch.schema.get_field_index("payload"))):
            out = []
            for r in part.to_pylist():
                first = r["first"]
                own = (fresh_id(r["record_id"]), r["page_id"], r["url"], r["date"], r["payload_digest"], r["payload_bytes"])
                if first is None:
                    made = record("response", *own, payload=r["payload"] or b"")
                else:
                    made = record("revisit", *own, refers=first | {"record_id": fresh_id(first["record_id"]) if first["here"] else first["record_id"]})
                out.append(made)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> str:
    """An archive with a response record for each row of pages, dated by date_col (a timestamp; null: DATE)."""
    date = F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(date, F.lit(DATE)).alias("date"))
    return write_archive(rows.mapInArrow(lean(_responses), "record string"), path)


def deduplicate(spark: SparkSession, path: str, to: str, min_bytes: int = MIN_BYTES) -> str:
    """A new archive in which records that repeat a payload of min_bytes or more are revisits.

    Of equal payloads the record of least page id is the response (null ids
    last, then by record id); records of fewer bytes are all responses. Revisit
    records of the input count by the digest and size that they name, and get
    their payloads from the response that holds it where they are responses
    now. Revisits whose payload no record of the archive holds stay as they are.
    Record ids and references are written anew; dates and addresses stay.
    Records of other types are left out.
    """
    headers = read_archive(spark, path).filter("record_type in ('response', 'revisit')")
    headers = keep(headers.select(F.col("record_id").alias("id"), "record_type", "page_id", "url", "date", "payload_digest", "payload_bytes", "refers_to_id", "refers_to", "refers_to_url", "refers_to_date"), "headers")
    key = ["payload_digest", "payload_bytes"]
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("id").alias("record_id"), "url", "date")
    original = F.when(F.col("record_type") == "response", F.col("id"))
    groups = headers.groupBy(*key).agg(F.min(order).alias("least"), F.min(original).alias("original"), F.count("*").alias("c"))
    # payloads that occur once, in a response, need no decision
    groups = keep(groups.filter("c > 1 or original is null"), "payloads")
    met = join_groups(headers, groups, key)
    refer = lambda record_id, page_id, url, date, here: F.struct(record_id.alias("record_id"), page_id.alias("page_id"), url.alias("url"), date.alias("date"), F.lit(here).alias("here"))
    mine = refer(F.col("least.record_id"), F.col("least.page_id"), F.col("least.url"), F.col("least.date"), True)
    theirs = refer(F.coalesce("refers_to_id", F.lit("")), F.col("refers_to"), F.col("refers_to_url"), F.coalesce("refers_to_date", "date"), False)
    repeats = (F.col("payload_bytes") >= min_bytes) & (F.col("id") != F.col("least.record_id"))
    first = F.when(F.col("original").isNull(), theirs).when(repeats, mine)
    decided = keep(met.select("id", *key, "record_type", "original", first.alias("first")), "decided")
    records = read_archive(spark, path, True).filter("record_type in ('response', 'revisit')")
    out = records.join(decided.select(F.col("id").alias("record_id"), "first"), "record_id", "left")
    # what is to be a response and has no payload gets that of an original
    lacking = decided.filter("first is null and record_type = 'revisit'").select(F.col("id").alias("record_id"), "original")
    if not lacking.isEmpty():
        sources = records.select(F.col("record_id").alias("original"), F.col("payload").alias("found")).join(lacking.select("original").distinct(), "original", "left_semi")
        out = out.join(lacking.join(sources, "original").select("record_id", "found"), "record_id", "left").withColumn("payload", F.coalesce("found", "payload"))
    return write_archive(out.select("record_id", "page_id", "url", "date", "payload_digest", "payload_bytes", "payload", "first").mapInArrow(lean(_renewed), "record string"), to)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, payload: every record with its full payload, revisits joined to their responses."""
    records = read_archive(spark, path, True)
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("payload").alias("original"))
    joined = records.withColumn("of", F.coalesce("refers_to_id", "record_id")).join(originals, "of", "left")
    return joined.select("page_id", "record_type", F.col("original").alias("payload"))


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url: one row for each row of pages, read back from a deduplicated archive.

    The payload is the html in UTF-8; null is empty. Of records with equal
    payloads of min_bytes or more one is a response, that of least page_id, and
    the others revisit it; shorter ones are all responses. Rows that repeat a
    page_id are records of their own; a null page_id comes after all others
    and, as a response, is referred to by null. Other columns are ignored; an
    empty table gives an empty result. Both archives stay in the shared folder.
    """
    spark = pages.sparkSession
    first = write_pages(pages, new_path(spark, "archive"), id_col, url_col, html_col)
    last = deduplicate(spark, first, new_path(spark, "archive"), min_bytes)
    return read_archive(spark, last).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
