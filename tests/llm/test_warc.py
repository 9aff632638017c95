"""Archives, their index, range reads, and the round trip against direct computation."""

import base64
import gzip
import hashlib

from compare import connect, difference

from scriptgauge.llm import queries, warc
from scriptgauge.session import scratch_path


def expected(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        first = max(ids) if ids and len(groups[h or ""]) > 1 else i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/ b\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, None, None), (3, "u", ""), (4, "u", "same"), (5, "u", "same"), (9, "v", "same"), (9, "v", "same")]
    rows += [(None, "n", "same"), (None, "n", "only null ids"), (7, "long", "x" * 9_000_000 + "é"), (-8, "neg", "negative")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, file string")
    found = warc.archive_round_trip(frame).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)
    assert warc.archive_round_trip(frame.limit(0)).collect() == []


def test_index_selects_ranges_of_valid_archives(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 50} " * (i % 9 + 1)) for i in range(300)], "page_id long, url string, html string").coalesce(2)
    index = warc.write_archives(frame, f"file://{tmp_path}/warc")
    for row in index.where("page_id < 40").collect():
        with open(tmp_path / "warc" / row.file, "rb") as f:
            f.seek(row.offset)
            raw = gzip.decompress(f.read(row.length))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and f"<urn:page:{row.page_id}>".encode() in raw
    chosen = warc.read_records(index.where("page_id % 7 = 0"), f"file://{tmp_path}/warc", payloads=True).collect()
    assert sorted(r.page_id for r in chosen) == list(range(0, 300, 7))
    assert all(r.payload.decode() == f"page {r.page_id % 50} " * (r.page_id % 9 + 1) for r in chosen if r.record_type == "response")


def test_ranges_join_neighbours():
    far = warc.GAP_BYTES + 100
    assert [(s, e) for s, e, _ in warc.ranges([(0, 10), (10, 5), (60, 5), (far + 70, 1)])] == [(0, 65), (far + 70, far + 71)]


def test_small_payloads_can_stay_responses(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.archive_round_trip(frame, min_bytes=5).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_query_against_sql(spark, small):
    assert difference(queries.op1_warc_round_trip(spark, small), connect(small), queries.SQL["op1_warc_round_trip"]) == ""


def test_folder_is_below_the_shared_one(spark):
    assert scratch_path(spark, "warc").count("warc-") == 1
