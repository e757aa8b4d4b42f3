import gzip
import hashlib

import pytest

from fieldscan.llm import warc
from fieldscan.llm.common import new_folder

BIG = "<p>" + "long page \r\n\r\n" * 120 + "</p>"
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/9", BIG), (9, "http://a/9", BIG), (3, "http://b\r\nX: y", "small"),
    (4, "http://b/4", "small"), (5, None, None), (6, "", ""), (None, "http://c", BIG), (7, "http://d", "ü" * 500), (8, "http://d", "ü" * 500), (10, "http://e", "ü" * 499),
]


def expected(pages):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if j is not None and (h or "") == (html or "")]
        answer = max(same) if same and len(data) >= 1000 and i is not None else i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if answer == i else "revisit", None if answer == i else answer))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, size int, digest string")


def test_pages_come_back_from_archives(spark):
    got = warc.archive_pages(frame(spark, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(PAGES)
    assert warc.archive_pages(frame(spark, [])).collect() == []


def test_archives_are_whole_records(spark):
    path = new_folder(spark, "test-warc")
    warc.write_archives(warc.resolved(warc.with_headers(frame(spark, PAGES))), path, compression="none", per_file=3)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    records = [r for f in files for r in warc.parse_records(f)]
    assert len(records) == len(PAGES) and max(len(list(warc.parse_records(f))) for f in files) <= 3
    ids = {r["fields"][b"warc-record-id"] for r in records if r["fields"][b"warc-type"] == b"response"}
    for r in records:
        if r["fields"][b"warc-type"] == b"revisit":
            assert r["fields"][b"warc-refers-to"] in ids and r["payload"] == b"" and r["fields"][b"warc-profile"].decode() == warc.PROFILE
        else:
            assert "sha1:" + hashlib.sha1(r["payload"]).hexdigest() == r["fields"][b"warc-payload-digest"].decode()
    assert sorted(bytes(r["payload"]) for r in warc.read_archives(spark, path).collect() if r["payload"] is not None) == sorted(r["payload"] for r in records if r["fields"][b"warc-type"] == b"response")


def test_broken_archives_raise():
    whole = b"WARC/1.1\r\nContent-Length: 6\r\n\r\nA\r\n\r\nb\r\n\r\n"
    assert [r["payload"] for r in warc.parse_records(whole)] == [b"b"]
    for broken in (whole[:-1], whole.replace(b"6", b"60"), b"junk"):
        with pytest.raises(ValueError):
            list(warc.parse_records(broken))
    assert warc.unpacked(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab" and warc.unpacked(b"plain") == b"plain"


def test_an_archive_read_in_chunks():
    import gzip

    from fieldscan.llm.warc import END, HTTP_HEAD, inflated, parse_records

    payloads = [b"", b"a\r\n\r\nb" * 40, bytes(range(256)) * 30]
    records = [f"WARC/1.1\r\nContent-Length: {len(HTTP_HEAD) + len(p)}\r\nX-N: {k}\r\n\r\n{HTTP_HEAD}".encode() + p + END.encode() for k, p in enumerate(payloads)]
    whole = b"".join(records)
    for raw in (whole, gzip.compress(whole), b"".join(map(gzip.compress, records))):
        for most in (1, 7, 1000):
            found = list(parse_records(inflated(raw, most) if raw != whole else [whole[i : i + most] for i in range(0, len(whole), most)]))
            assert [r["payload"] for r in found] == payloads and [r["fields"][b"x-n"] for r in found] == [b"0", b"1", b"2"]
    assert len(list(parse_records(whole))) == 3
    for broken in (gzip.compress(whole)[:-40], gzip.compress(whole[:-9]), b"junk" + whole):
        try:
            list(parse_records(inflated(broken, 50)))
        except ValueError:
            continue
        raise AssertionError("a broken archive was read")
