"""ZIP archives read by byte range."""

import io
import random
import zipfile

from scriptgauge.plans import catalog
from scriptgauge.sources import archives, readers
from scriptgauge.streaming import jobs


def told(frame):
    return sorted((r.archive.rsplit("/", 1)[-1], r.member or "", r.src, r.error is not None) for r in frame.collect())


def pack(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as archive:
        for name, content in members:
            archive.writestr(name, content)


def test_members_of_every_kind(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    pack(tmp_path / "a.zip", [("x/", ""), ("x/one.SQL", "SELECT 1"), ("x/note.txt", "no"), ("empty.sql", ""), ("x/é.sql", "数据".encode("gbk"))])
    pack(tmp_path / "sub" / "b.zip", [("two.sql", "SELECT 2")], zipfile.ZIP_STORED)
    pack(tmp_path / "c.zip", [("three.sql", "SELECT 3 " * 1000)], zipfile.ZIP_BZIP2)
    pack(tmp_path / "d.zip", [])
    (tmp_path / "e.zip").write_bytes(b"no zip")
    (tmp_path / "f.zip").write_bytes(b"PK")
    (tmp_path / "none.zip").write_bytes(b"")
    (tmp_path / "g.zip").write_bytes(b"some bytes before" + (tmp_path / "a.zip").read_bytes())
    assert told(archives.read_archives(spark, str(tmp_path))) == sorted(
        [(z, "empty.sql", "", False) for z in ("a.zip", "g.zip")]
        + [(z, "x/one.SQL", "SELECT 1", False) for z in ("a.zip", "g.zip")]
        + [(z, "x/é.sql", "数据", False) for z in ("a.zip", "g.zip")]
        + [("b.zip", "two.sql", "SELECT 2", False), ("c.zip", "three.sql", "SELECT 3 " * 1000, False)]
        + [("e.zip", "", None, True), ("f.zip", "", None, True)],
        key=lambda r: r[:2],
    )


def test_damaged_locked_and_unknown_members_are_rows_with_an_error(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for i in range(5):
            archive.writestr(f"{i}.sql", f"SELECT {i}")
    raw = bytearray(buffer.getvalue())
    raw[raw.index(b"SELECT 1")] ^= 1
    entry = [raw.index(b"PK\x01\x02")]
    for _ in range(4):
        entry.append(raw.index(b"PK\x01\x02", entry[-1] + 1))
    raw[entry[2] + 8] |= 1  # the directory says that it is encrypted
    raw[entry[3] + 10] = 99  # and that this one is of an unknown method
    raw[raw.index(b"PK\x03\x04", raw.index(b"SELECT 3"))] ^= 1
    (tmp_path / "x.zip").write_bytes(raw)
    assert told(archives.read_archives(spark, str(tmp_path))) == [("x.zip", "0.sql", "SELECT 0", False)] + [("x.zip", f"{i}.sql", None, True) for i in range(1, 5)]


def test_one_archive_is_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    members = [(f"m{i}.sql", "SELECT " + "".join(rng.choices("abcdef ", k=rng.randrange(3000)))) for i in range(400)]
    pack(tmp_path / "x.zip", [*members, ("large.sql", "x" * 100_000)], zipfile.ZIP_STORED)
    monkeypatch.setattr(archives, "STRETCH_BYTES", 20_000)
    frame = archives.read_archives(spark, str(tmp_path))
    used = frame.select("member", "src").rdd.glom().map(len).collect()
    assert sum(used) == 401 and sum(n > 0 for n in used) >= 5
    assert {r.member: r.src for r in frame.collect()} == dict([*members, ("large.sql", "x" * 100_000)])


def test_no_archives(spark, tmp_path):
    pack(tmp_path / "x.zip", [("a.txt", "no")])
    assert archives.read_archives(spark, str(tmp_path)).collect() == []
    assert archives.read_members(archives.member_index(spark.createDataFrame([], "path string"))).collect() == []


def test_written_archives_as_a_stream(spark, tmp_path):
    scripts = spark.createDataFrame([(f"in/{i}.sql", f"SELECT {i}") for i in range(130)], "path string, src string")
    written = archives.write_archives(scripts, str(tmp_path / "zips"))
    assert told(archives.read_members(archives.member_index(written))) == told(archives.read_archives(spark, str(tmp_path / "zips")))
    read = lambda batch: archives.read_members(archives.member_index(batch))
    found = jobs.run_batches(archives.stream_archives(spark, str(tmp_path / "zips")), read, "zips")
    assert sorted((r.member, r.src) for r in found.collect()) == sorted((f"in/{i}.sql", f"SELECT {i}") for i in range(130))


def test_archives_are_parted_by_size_not_by_number(spark):
    """A few scripts per archive would be a million files at 6 GB; long scripts still part them."""
    short = spark.createDataFrame([(f"in/{i}.sql", "SELECT 1;") for i in range(400)], "path string, src string").coalesce(1)
    assert readers.pack_archives(short).count() == 1
    long = spark.createDataFrame([(f"in/{i}.sql", "x" * 3_000_000) for i in range(4)] + [("in/e.sql", "")], "path string, src string").coalesce(1)
    sizes = [len(zipfile.ZipFile(io.BytesIO(bytes(r.content))).namelist()) for r in readers.pack_archives(long).collect()]
    assert sum(sizes) == 5 + 2 * len(sizes) and len(sizes) == 4


def test_stream_keeps_no_texts(spark, small, monkeypatch):
    kept = []
    monkeypatch.setattr(jobs, "run_batches", lambda stream, transform, label: kept.append(transform(spark.createDataFrame([], "path string")).columns))
    catalog.stream_zip(spark, small)
    assert kept == [["base_name", "charset", "chars", "text_hash"]]
