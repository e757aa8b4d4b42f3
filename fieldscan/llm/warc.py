"""WARC archives with revisit records.

Headers are shuffled by payload digest to find the record that answers for equal payloads;
the others become revisits without a payload. Reading goes the other way: revisit records
are joined to the responses they refer to.

Archives are written by Spark's text writer with the record end ``CRLF CRLF`` as line
separator, so each file is a valid sequence of records on any file system Spark reaches.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, require, saved, utf8

LEAST_BYTES = 1000
RECORDS_PER_FILE = 20_000
CHUNK_BYTES = 4 << 20
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
END = "\r\n\r\n"

RECORD_SCHEMA = (
    "record_id string, record_type string, page_id long, url string, refers_to_id string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def record_id(digest: Column, page_id: Column, url: Column) -> Column:
    """The same urn for the same page, address and content, in every run."""
    h = F.sha2(F.concat_ws("|", digest, F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))), 256)
    part = lambda start, n: F.substring(h, start, n)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(13, 3), F.lit("-8"), part(16, 3), F.lit("-"), part(19, 12))


def with_headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A record per page: ids, both digests, size and payload. Null html is the empty payload.

    ``same`` is what equal payloads share: SHA-256 and size, since SHA-1 alone can be forged.
    Line ends in an address become blanks, or they would end its header line.
    """
    require(pages, id_col, url_col, html_col)
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.regexp_replace(F.col(url_col), "[\\r\\n]+", " ")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    body = utf8("html")
    rows = rows.withColumns({"digest": F.sha1(body), "same": F.sha2(body, 256), "size": F.octet_length(body).cast("long")})
    return rows.withColumn("record_id", record_id(F.col("same"), F.col("page_id"), F.col("url")))


def resolved(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Adds ``refers_to`` (page) and ``refers_to_id`` (record): set for revisits, null for responses.

    Of records with equal payloads of ``least`` bytes or more, the largest page_id answers.
    Rows that repeat that page_id all answer; records without a page_id answer for themselves.
    Only ids travel to find the answer: payloads are joined by page, not by content, so
    many copies of one payload do not meet in one task.
    """
    heads = saved(records.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).select("same", "page_id", "record_id"), "heads")
    groups = heads.groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).filter("n > 1").drop("n")
    members = heads.join(groups, "same")
    answers = members.filter("page_id = refers_to").groupBy("same").agg(F.min("record_id").alias("refers_to_id"))
    revisits = members.filter("page_id <> refers_to").select("same", "page_id", "refers_to").distinct().join(answers, "same")
    return records.join(revisits, ["page_id", "same"], "left")


def record_text(date: str) -> Column:
    """A whole record but for its end: header block, blank line, content block."""
    revisit = F.col("refers_to_id").isNotNull()
    head = F.lit(HTTP_HEAD)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    bracketed = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    size = F.lit(len(HTTP_HEAD)) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", bracketed(F.col("record_id"))),
        line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", F.col("url")),
        optional("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", bracketed(F.col("refers_to_id"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
        head,
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )


def write_archives(
    records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", per_file: int = RECORDS_PER_FILE
) -> None:
    """Writes resolved records as archives. A file never holds more than ``per_file`` records."""
    (
        records.select(record_text(date).alias("value"))
        .write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)
    )


_FIELD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def inflated(raw: bytes, most: int = CHUNK_BYTES) -> Iterator[bytes]:
    """An archive's bytes in chunks, of one or many gzip members or none."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        member = zlib.decompressobj(31)
        while not member.eof:
            chunk = member.decompress(raw, most)
            raw = member.unconsumed_tail
            if chunk:
                yield chunk
            elif not raw and not member.eof:
                raise ValueError("the archive is cut off")
        raw = member.unused_data


def unpacked(raw: bytes) -> bytes:
    """An archive's bytes, all at once."""
    return b"".join(inflated(raw))


class _Reader:
    """Bytes that come in chunks, of which only those not yet taken are held."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held, self.passed = iter(chunks), bytearray(), 0

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held += chunk
        return True

    def find(self, mark: bytes) -> int:
        start = 0
        while True:
            at = self.held.find(mark, start)
            if at >= 0:
                return at
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.passed += len(out)
        return out


def parse_records(data: bytes | Iterable[bytes]) -> Iterator[dict]:
    """The records of an archive, payload without its HTTP head; ``data`` may come in chunks, and
    no more than a record and a chunk is held. A broken record raises ValueError."""
    source = _Reader([data] if isinstance(data, bytes) else data)
    while source.held or source.more():
        at = source.passed
        stop = source.find(END.encode())
        if stop < 0 or not source.held.startswith(b"WARC/1."):
            raise ValueError(f"no record at byte {at}")
        head = source.take(stop + 4)
        fields = {k.lower(): v for k, v in _FIELD.findall(head, head.index(b"\r\n") + 2, stop + 2)}
        size = int(fields[b"content-length"])
        block = source.take(size)
        if len(block) < size or source.take(4) != END.encode():
            raise ValueError(f"the record at byte {at} is cut off")
        yield {"fields": fields, "payload": block[block.index(END.encode()) + 4 :]}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``; see ``RECORD_SCHEMA``.

    ``payload_digest`` is that of the header; a response whose payload does not have it raises.
    Without ``payloads`` that column is null, though payloads were read and checked.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        types = [kinds.get(n, pa.string()) for n in names]
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                rows, held = [], 0
                for record in parse_records(inflated(raw)):
                    f, payload = record["fields"], record["payload"]
                    kind, digest = f[b"warc-type"].decode(), f[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError("a payload does not have the digest of its header")
                    text = lambda name: f[name].decode().strip("<>") if name in f else None
                    page = text(b"x-page-id")
                    full = kind == "response"
                    size, kept = (len(payload) if full else None), (payload if full and payloads else None)
                    heads = text(b"warc-record-id"), kind, None if page is None else int(page), text(b"warc-target-uri"), text(b"warc-refers-to")
                    rows.append((*heads, digest, size, kept))
                    held += len(payload) if payloads else 256
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def with_payloads(records: DataFrame) -> DataFrame:
    """Revisits joined to the responses they refer to: ``payload_bytes`` and ``refers_to`` page.

    Payloads stay where they are; a reader that needs one follows ``refers_to_id``.
    """
    heads = records.drop("payload")
    answers = (
        heads.filter("record_type = 'response'").groupBy(F.col("record_id").alias("answer"))
        .agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("answer_bytes"))
    )
    # Only revisits look for an answer; a null key joins nothing and stays in its partition's share.
    revisits = heads.filter("record_type = 'revisit'").join(answers, F.col("refers_to_id") == F.col("answer"))
    columns = ["page_id", "url", "record_id", "refers_to_id", "payload_digest", "record_type"]
    return revisits.select(*columns, F.col("answer_bytes").alias("payload_bytes"), "refers_to").union(
        heads.filter("record_type = 'response'").select(*columns, "payload_bytes", F.lit(None).cast("long").alias("refers_to"))
    )


def archive_pages(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Writes pages as deduplicated archives and returns what reading them back gives.

    One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and
    more. Null html is an empty payload, a null page_id or url stays null; repeated rows are
    records of their own (of a page repeated as the answer, both are responses); an empty
    table gives archives without records and an empty result. Columns other than the three
    named ones are not read.
    """
    path = path or new_folder(pages.sparkSession, "warc")
    write_archives(resolved(with_headers(pages), least), path)
    return with_payloads(read_archives(pages.sparkSession, path, payloads=False))
