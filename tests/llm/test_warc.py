import gzip
import hashlib

import pytest

from demandlens.llm.warc import archive_round_trip, member, read_warc, record, write_warc


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é</p>" * 40
    rows = [
        (5, "http://a", big), (3, None, big), (9, "http://b\r\nX: y", big), (1, "u", None), (2, "u", ""), (4, "u", "short"),
        (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\n" * 30), (7, "u", "WARC/1.1\r\n\r\n" * 30), (None, "u", big),
        (8, "u", "long " * 500_000),
    ]
    rows = [(*r, "own", 1) for r in rows]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, bytes int")


def expected(rows):
    out = []
    for page, html in rows:
        data = (html or "").encode()
        same = [p for p, h in rows if h == html and p is not None]
        first = min(same, default=None)
        response = len(data) < 100 or page is None or page == first
        kind = "response" if response else "revisit"
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), kind, None if response else first))
    return sorted(out, key=repr)


def told(df):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


def test_odd_pages(pages):
    want = expected([(r.page_id, r.html) for r in pages.collect()])
    assert told(archive_round_trip(pages)) == want
    assert told(archive_round_trip(pages.limit(0))) == []


@pytest.mark.parametrize("split", [7, 64, 1000])
def test_any_split_finds_every_record_once(spark, pages, tmp_path, split):
    small = pages.filter("page_id is null or page_id < 8")
    files = write_warc(small, str(tmp_path / "w"), archive_bytes=600)
    assert files.count() > 1
    found = read_warc(spark, files, split_bytes=split)
    assert told(found) == expected([(r.page_id, r.html) for r in small.collect()])
    assert found.filter("not digest_matches").count() == 0
    payloads = {r.page_id: r.payload for r in found.filter("record_type = 'response'").collect()}
    assert payloads[4] == b"short" and payloads[1] == b""


def test_archives_are_gzip_members_of_plain_records(pages, tmp_path):
    files = write_warc(pages.filter("page_id in (1, 4)"), str(tmp_path / "w")).collect()
    text = b"".join(gzip.decompress(open(f.path, "rb").read()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"\r\n\r\n") and b"WARC-Record-ID: <urn:page:4>" in text


def test_what_is_no_member_is_passed_over(spark, tmp_path):
    good = member(record(1, "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), None, "d"), 6)
    wrong = member(record(2, "u", b"payload", 7, "0" * 64, None, "d"), 6)
    data = b"\x1f\x8b\x08junk" + good + b"\x1f\x8b\x08" + gzip.compress(b"no record") + good[:-9] + wrong
    path = str(tmp_path / "a.warc.gz")
    open(path, "wb").write(data)
    files = spark.createDataFrame([(path, len(data))], "path string, bytes long")
    found = sorted((r.page_id, r.digest_matches) for r in read_warc(spark, files, split_bytes=11).collect())
    assert found == [(1, True), (2, False)]
