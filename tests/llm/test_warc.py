"""Archives: round trip, index, ranges."""

import gzip
import hashlib

import pytest

from cohortlab.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, row int"


def expected(rows):
    """(page_id, bytes, digest, type, refers_to) of each row, where no page id occurs twice."""
    out = []
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == payload]
        last = max((p for p in same if p is not None), default=None)
        revisit = len(payload) >= 1000 and page_id != last
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return out


def test_round_trip_with_revisits(spark):
    long, wide = "<p>a\r\n\r\nWARC/1.1\r\n</p>" * 100, "é" * 500  # 1000 bytes in 500 characters
    rows = [
        (1, "http://a/1", long, "x", 1),
        (7, "http://a/7", long, "x", 1),
        (3, None, long, "x", 1),
        (4, "http://a/\r\nX: y", wide, "x", 1),
        (5, "", wide, "x", 1),
        (6, "http://a/6", "short", "x", 1),
        (8, "http://a/8", "short", "x", 1),
        (9, "http://a/9", None, "x", 1),
        (None, "http://a/n", "", "x", 1),
        (10, "http://a/10", "y" * 3_000_000, "x", 1),
    ]
    got = warc.archive_round(spark.createDataFrame(rows, SCHEMA).repartition(3))
    key = lambda r: (r[0] is None, r[0])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(expected(rows), key=key)
    urls = {r["page_id"]: r["url"] for r in got.collect()}
    assert urls[3] is None and urls[5] == "" and urls[4] == "http://a/%0D%0AX: y" and urls[10] == "http://a/10"


def test_repeated_rows_have_one_response(spark):
    rows = [(5, "u", "z" * 2000, "x", 1)] * 3 + [(2, "u", "z" * 2000, "x", 1), (None, "u", "z" * 2000, "x", 1)]
    got = warc.archive_round(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["record_type"] for r in got) == ["response"] + ["revisit"] * 4
    assert {r["page_id"] for r in got if r["record_type"] == "response"} == {5}
    assert {(r["refers_to"], r["payload_bytes"]) for r in got if r["record_type"] == "revisit"} == {(5, 2000)}


def test_empty_table(spark):
    assert warc.archive_round(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.fixture(scope="module")
def archived(spark, small, tmp_path_factory):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    folder = str(tmp_path_factory.mktemp("warc"))
    return pages, warc.write_archives(pages.repartition(3), folder, archive_bytes=20_000)


def test_scanned_index_equals_the_written_one(spark, archived):
    _, index = archived
    paths = [r[0] for r in index.select("path").distinct().collect()]
    assert len(paths) > 3
    again = warc.index_archives(spark, paths)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index.collect()))
    one = paths[0]
    data = open(one, "rb").read()
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert sum(r["length"] for r in index.collect() if r["path"] == one) == len(data)


def test_uncompressed_archives_are_indexed_and_read(spark, archived, tmp_path):
    pages, index = archived
    one = index.select("path").first()[0]
    plain = tmp_path / "plain.warc"
    plain.write_bytes(gzip.decompress(open(one, "rb").read()))
    fields = ["record_id", "url", "payload_digest", "payload", "intact"]
    got = warc.read_records(warc.index_archives(spark, [str(plain)])).select(fields)
    want = warc.read_records(index.where(index.path == one)).select(fields)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_selected_records_have_their_payloads(spark, archived):
    pages, index = archived
    chosen = index.where("hash(url) % 3 = 0")
    got = {r["page_id"]: (r["url"], bytes(r["payload"]).decode()) for r in warc.read_records(chosen).collect() if r["payload"] is not None}
    want = {r["page_id"]: (r["url"], r["html"]) for r in pages.collect()}
    assert 0 < len(got) < len(want)
    assert all(want[k] == v for k, v in got.items())


def test_damage_is_found(spark, archived, tmp_path):
    _, index = archived
    one = index.select("path").first()[0]
    data = bytearray(gzip.decompress(open(one, "rb").read()))
    plain = tmp_path / "damaged.warc"
    data[-6] ^= 1  # of the last payload
    plain.write_bytes(bytes(data))
    assert [r["intact"] for r in warc.read_records(warc.index_archives(spark, [str(plain)])).collect()].count(False) == 1


def test_neighbouring_ranges_become_one_read():
    ranges = [("a", 0, 10), ("a", 10, 5), ("a", 18, 5), ("a", 40, 5), ("b", 45, 5), ("b", 50, 500)]
    runs = list(warc.coalesce(iter(ranges), read_bytes=100, gap_bytes=4))
    assert runs == [("a", [(0, 10), (10, 5), (18, 5)]), ("a", [(40, 5)]), ("b", [(45, 5)]), ("b", [(50, 500)])]
