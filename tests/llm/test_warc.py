import base64
import gzip
import hashlib
import io
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from rotapanel.llm import warc

HTML = "<p>ä" + "x" * 100


@pytest.fixture
def pages(spark):
    rows = [
        (5, "http://a/1", HTML), (3, "http://a/2", HTML), (9, "http://a/3", HTML), (9, "http://a/3", HTML), (None, "u", HTML),
        (1, "http://b/", "short"), (2, None, "short"), (4, "http://c/\r\nX-Evil: 1", None), (6, "http://d/", ""), (7, "é", "y" * 300_000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit("own"))


def test_round_trip(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    folder = warc.archive_folder(spark, "t")
    archives = warc.write_archives(pages, folder)
    assert archives.agg(F.sum("n_records")).first()[0] == 10
    rows = warc.read_archives(archives).collect()
    html = {(r.page_id, r.url): (r.html or "").encode() for r in pages.collect()}
    types = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows)
    assert types == [
        (0, "revisit", 3), (1, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 3),
        (6, "response", None), (7, "response", None), (9, "revisit", 3), (9, "revisit", 3),
    ]
    for r in rows:
        if r.page_id != 4:
            data = html[(r.page_id, r.target_uri)]
            assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
            assert r.record_type == "revisit" or r.payload == data
    assert next(r.target_uri for r in rows if r.page_id == 4) == "http://c/%0D%0AX-Evil: 1"


def test_archives_are_gzip_members_with_framed_records(spark, pages):
    archives = warc.write_archives(pages, warc.archive_folder(spark, "t")).collect()
    for a in archives:
        data = open(a.path.removeprefix("file://"), "rb").read()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == a.n_records == len(list(warc.records(io.BytesIO(data), True, 7)))


def record(**more):
    return warc.record_bytes(1, "http://x/", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)


def test_wrong_records_are_found():
    good = record()
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-5], good + b"x", good.replace(b"payload", b"PAYLOAD"), b"x" + good):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    wrong = warc.record_bytes(1, "http://x/", b"payload", "0" * 64, None, False)
    with pytest.raises(ValueError):
        warc.parse_record(wrong)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(warc.gzip_member(good)[:-9])))


def test_no_rows(spark, pages):
    archives = warc.write_archives(pages.where("page_id < 0"), warc.archive_folder(spark, "t"))
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0


def test_only_null_ids(spark):
    pages = spark.createDataFrame([(None, "u", HTML), (None, "u", HTML)], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages, warc.archive_folder(spark, "t"))).collect()
    assert [(r.record_type, r.refers_to) for r in rows] == [("response", None)] * 2


def test_records_of_any_length_are_read_in_bounded_memory():
    """A record of 300 MB that deflates well; what the reader holds stays below a few pieces."""
    block = bytes(1 << 20)
    size = 300 * len(block)
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % size
    whole, payload = hashlib.sha256(http), hashlib.sha256()
    for _ in range(300):
        whole.update(block)
        payload.update(block)
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:8>\r\nContent-Type: application/http\r\nWARC-Block-Digest: sha256:{whole.hexdigest()}"
        f"\r\nWARC-Payload-Digest: sha256:{payload.hexdigest()}\r\nContent-Length: {size + len(http)}\r\n\r\n"
    ).encode()
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    member = b"".join([deflate.compress(head + http), *[deflate.compress(block) for _ in range(300)], deflate.compress(b"\r\n\r\n"), deflate.flush()])
    tracemalloc.start()
    found = list(warc.records(io.BytesIO(member + warc.gzip_member(record())), payloads=False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["page_id"], r["payload_bytes"], r["payload"]) for r in found] == [(8, size, None), (1, 7, None)]
    assert found[0]["payload_digest"] == payload.hexdigest() and peak < 16 * warc.READ


def test_members_with_several_records_and_records_of_other_kinds():
    note = b"software: x\r\n"
    sha1 = base64.b32encode(hashlib.sha1(note).digest()).decode()
    info = (
        f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nWARC-Block-Digest: sha1:{sha1}\r\n"
        f"Content-Length: {len(note)}\r\n\r\n"
    ).encode() + note + b"\r\n\r\n"
    empty = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    data = warc.gzip_member(info + empty + record()) + warc.gzip_member(record())
    for read in (1, 7, 1 << 18):
        found = list(warc.records(io.BytesIO(data), True, read))
        assert [(r["record_type"], r["page_id"], r["payload"]) for r in found] == [
            ("warcinfo", None, note), ("metadata", None, b""), ("response", 1, b"payload"), ("response", 1, b"payload"),
        ]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(warc.gzip_member(info.replace(b"software", b"hardware")))))
    with pytest.raises(ValueError):  # a record over two members
        list(warc.records(io.BytesIO(warc.gzip_member(info[:-9]) + warc.gzip_member(info[-9:]))))


def test_revisits_must_tell_the_payload_of_their_response(spark):
    rows = [(1, "response", "a", None), (2, "revisit", "a", 1), (3, "revisit", "a", 1)]
    schema = "page_id long, record_type string, payload_digest string, refers_to long"
    warc.check_revisits(spark.createDataFrame(rows, schema))
    for wrong in ((4, "revisit", "b", 1), (4, "revisit", "a", 9)):
        with pytest.raises(ValueError):
            warc.check_revisits(spark.createDataFrame([*rows, wrong], schema))
