import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from effectspark.llm import warc


@pytest.fixture()
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id bigint, url string, payload binary").repartition(3)

    return make


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/archives"


def archive(pages, tables, folder):
    return warc.write(warc.decide_revisits(pages), tables, folder)


def rows_of(n=40):
    same, big, small = b"s" * 1000, b"<html>" + bytes(range(256)) * 9000, b"t" * 999
    kinds = [same, big, small, b"", b"\x1f\x8b\x08 looks like gzip " * 60]
    return [(i, f"http://h/{i}?q=é \r\nx", kinds[i % 5] if i % 7 else f"{i}".encode() * 400) for i in range(n)]


def expected(rows):
    groups = defaultdict(list)
    for i, _, p in rows:
        groups[p].append(i)
    out = {}
    for i, _, p in rows:
        head = max(groups[p])
        revisit = len(p) >= 1000 and head != i
        out[i] = (len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", f"urn:page:{head}" if revisit else None)
    return out


@pytest.mark.parametrize("range_bytes", [1 << 20, 5000, 64, 17])
def test_every_record_is_read_once_whatever_the_ranges(pages, tables, folder, range_bytes):
    rows = rows_of()
    files = archive(pages(rows), tables, folder)
    got = warc.read(files.df, range_bytes).collect()
    assert len(got) == len(rows)
    found = {int(r.record_id[9:]): (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got}
    assert found == expected(rows)


def test_payloads_come_back(pages, tables, folder):
    rows = rows_of()
    files = archive(pages(rows), tables, folder)
    kept = {i: e for i, e in expected(rows).items() if e[2] == "response"}
    got = {int(r.record_id[9:]): bytes(r.payload) for r in warc.read(files.df, payload=True).collect() if r.record_type == "response"}
    assert got == {i: p for i, _, p in rows if i in kept}


def test_members_are_plain_gzip(pages, tables, folder):
    files = archive(pages(rows_of(5)), tables, folder).df.collect()
    for f in files:
        content = gzip.open(f.path.removeprefix("file://")).read()
        assert content.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        assert content.count(b"WARC/1.1\r\n") == f.records + 1


def test_odd_pages(pages, tables, folder):
    same = b"x" * 2000
    rows = [(None, None, None), (None, "u", same), (None, "u", b"y" * 2000), (None, "u", b"y" * 2000), (1, None, same),
            (2, "", same), (2, "", same), (3, "u", b"")]
    got = warc.read(archive(pages(rows), tables, folder).df).collect()
    found = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes) for r in got)
    assert found == [
        ("urn:page:1", "revisit", "urn:page:2", 2000), ("urn:page:2", "response", "", 2000),
        ("urn:page:2", "response", "", 2000), ("urn:page:3", "response", "", 0),
        ("urn:page:none", "response", "", 0), ("urn:page:none", "response", "", 2000),
        ("urn:page:none", "response", "", 2000), ("urn:page:none", "revisit", "urn:page:2", 2000),
    ]


def test_no_pages(pages, tables, folder):
    assert warc.read(archive(pages([]), tables, folder).df).count() == 0


def test_files_that_are_not_listed_are_not_read(pages, tables, folder):
    first = archive(pages(rows_of(10)), tables, folder)
    archive(pages(rows_of(10)), tables, folder)
    assert warc.read(first.df).count() == 10


def test_stray_magic_and_other_members_are_passed_over(tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    wrong_length = record.replace(b"Length: 3", b"Length: 300")
    parts = [b"junk\x1f\x8b\x08junk", gzip.compress(record), gzip.compress(b"no archive"), gzip.compress(wrong_length),
             gzip.compress(b""), gzip.compress(record), gzip.compress(record)[:30]]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(parts))
    found = list(warc.scan(f"file://{path}", 0, 10**9))
    assert [r.block for r in found] == [b"abc", b"abc"]
    whole = path.stat().st_size
    for cut in range(whole):
        assert len([*warc.scan(f"file://{path}", 0, cut), *warc.scan(f"file://{path}", cut, whole)]) == 2


def test_a_changed_payload_is_an_error(pages, tables, folder, monkeypatch):
    files = archive(pages([(1, "u", b"z" * 50)]), tables, folder)
    path = files.df.first().path.removeprefix("file://")
    content = gzip.open(path).read().replace(b"zz", b"yy")
    info, record = content.split(b"\r\n\r\nWARC/", 1)
    open(path, "wb").write(gzip.compress(info + b"\r\n\r\n") + gzip.compress(b"WARC/" + record))
    listed = files.df.withColumn("bytes", F.lit(10_000))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read(listed).collect()
