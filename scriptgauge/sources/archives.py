"""Read ZIP archives by byte range: a job lists the members first, others read them.

``member_index`` reads only the directory at the end of each archive and gives one
narrow row per script in it. ``read_members`` cuts archives into stretches of
STRETCH_BYTES, deals whole stretches to tasks and reads each as a few ranges, so one
large archive is many tasks and no archive is ever in memory as a whole. Listing is a
job of its own because the driver would otherwise open every archive itself. Batch and
stream use the same two steps; a stream's rows are the archives that are new.

Defined results: an archive without a readable directory is a row with its error and
no member; a member that cannot be read (damaged, encrypted, of an unknown method) is
a row with its error and no text. Folders and files of other kinds are left out.
Members of equal names are all read. An empty list of archives gives no rows, and a
file of no bytes is not listed.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import materialize
from .readers import MEMBER_SCHEMA, decode, pack_archives

#: Members that start in the same stretch of an archive are read by one task; so much of an archive is in memory at a time.
STRETCH_BYTES = 16_000_000
#: A task reads about so many bytes of archives.
TASK_BYTES = 128_000_000
INDEX_ROWS = 10_000
INDEX_SCHEMA = "archive string, member string, start long, stop long, packed long, size long, crc long, method int, locked boolean, error string"
INDEX_COLUMNS = [part.split()[0] for part in INDEX_SCHEMA.split(", ")]
# Fixed values of the format: a member's own header, of which the lengths of its name and extra field are read
LOCAL_HEADER, LOCAL_MARK = struct.Struct("<4s22xHH"), b"PK\x03\x04"


def _open(path: str):
    """The file behind a path or URI of Spark's, which writes ``file:/x`` for ``file:///x``."""
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    files, base = pafs.FileSystem.from_uri(uri)
    return files.open_input_file(base)


class _Seekable:
    """A file as ``zipfile`` expects it: a seek before the first byte is an ``OSError``."""

    def __init__(self, file):
        self.file, self.read, self.tell, self.seekable = file, file.read, file.tell, file.seekable

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except ValueError as error:
            raise OSError(str(error)) from error


def _directory(path: str) -> Iterator[tuple]:
    """Index rows of one archive, in the order of their bytes; a member ends where the next one starts."""
    with _open(path) as file:
        try:
            with zipfile.ZipFile(_Seekable(file)) as archive:
                infos = sorted(archive.infolist(), key=lambda info: info.header_offset)
                stops = [info.header_offset for info in infos[1:]] + [archive.start_dir]
        except (zipfile.BadZipFile, struct.error, NotImplementedError) as error:
            yield (path, None, 0, 0, 0, 0, 0, 0, False, str(error))
            return
    for info, stop in zip(infos, stops):
        if not info.is_dir() and info.filename.lower().endswith(".sql"):
            yield (path, info.filename, info.header_offset, stop, info.compress_size, info.file_size, info.CRC, info.compress_type, bool(info.flag_bits & 1), None)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the ZIP files below ``path``; their bytes are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return files.select("path")


def stream_archives(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (path): the ZIP files that arrive in the folder ``path``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")


def member_index(archives: DataFrame) -> DataFrame:
    """One row per script of the archives (path): name, byte range, sizes, checksum and method."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                for row in _directory(path):
                    rows.append(row)
                    if len(rows) == INDEX_ROWS:
                        yield pd.DataFrame(rows, columns=INDEX_COLUMNS)
                        rows = []
            yield pd.DataFrame(rows, columns=INDEX_COLUMNS)

    return archives.select("path").mapInPandas(run, INDEX_SCHEMA)


def unpack(raw: bytes, packed: int, size: int, crc: int, method: int) -> bytes:
    """A member's content from its bytes, which start at its own header."""
    if len(raw) < LOCAL_HEADER.size:
        raise zipfile.BadZipFile("member is cut off")
    mark, name, extra = LOCAL_HEADER.unpack_from(raw)
    if mark != LOCAL_MARK:
        raise zipfile.BadZipFile("no member where the directory names one")
    body = raw[LOCAL_HEADER.size + name + extra :][:packed]
    if method == zipfile.ZIP_STORED:
        content = body
    elif method == zipfile.ZIP_DEFLATED:
        content = zlib.decompressobj(-zlib.MAX_WBITS).decompress(body, size + 1)
    elif method == zipfile.ZIP_BZIP2:
        content = bz2.BZ2Decompressor().decompress(body, size + 1)
    else:
        raise NotImplementedError(f"compression method {method}")
    if len(content) != size or zlib.crc32(content) != crc:
        raise zipfile.BadZipFile("content does not match its checksum")
    return content


def read_members(index: DataFrame) -> DataFrame:
    """(archive, member, charset, src, error) of indexed members, read by byte range."""
    index = materialize(index, "members")
    stretch = (F.col("start") / STRETCH_BYTES).cast("long")
    total = index.agg(F.count_distinct("archive", stretch).alias("stretches"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).first()
    tasks = max(1, min(total["stretches"], max(index.sparkSession.sparkContext.defaultParallelism, (total["bytes"] or 0) // TASK_BYTES)))
    dealt = index.withColumn("stretch", stretch).repartition(tasks, "archive", "stretch").sortWithinPartitions("archive", "start")

    def text(row, raw: bytes) -> tuple:
        try:
            if row.locked:
                raise RuntimeError("member is encrypted")
            src, charset = decode(unpack(raw, row.packed, row.size, row.crc, row.method))
            return row.archive, row.member, charset, src, None
        except (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError) as error:
            return row.archive, row.member, None, None, str(error)

    def read(rows: list) -> pd.DataFrame:
        """The members of neighbouring rows of one archive by one range read."""
        first = rows[0].start
        with _open(rows[0].archive) as file:
            file.seek(first)
            raw = memoryview(file.read(max(row.stop for row in rows) - first))
        return pd.DataFrame([text(row, bytes(raw[row.start - first : row.stop - first])) for row in rows], columns=["archive", "member", "charset", "src", "error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near: list = []
            for row in batch.itertuples(index=False):
                if row.error is not None and row.member is None:
                    yield pd.DataFrame([(row.archive, None, None, None, row.error)], columns=["archive", "member", "charset", "src", "error"])
                    continue
                if near and (row.archive != near[0].archive or row.stop - near[0].start > STRETCH_BYTES):
                    yield read(near)
                    near = []
                near.append(row)
            if near:
                yield read(near)

    return dealt.mapInPandas(run, MEMBER_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All scripts of all archives below ``path``."""
    return read_members(member_index(list_archives(spark, path)))


def write_archives(scripts: DataFrame, folder: str) -> DataFrame:
    """(path) of the ZIP files that hold ``scripts`` (path, src), written below ``folder``.

    A file is named by its content and exists for readers only if it is in the result,
    so one left by a lost or repeated task is never read from there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base)
        for batch in batches:
            paths = []
            for content in map(bytes, batch["content"]):
                name = hashlib.md5(content).hexdigest() + ".zip"
                with files.open_output_stream(f"{base}/{name}") as out:
                    out.write(content)
                paths.append(f"{folder}/{name}")
            yield pd.DataFrame({"path": paths})

    return materialize(pack_archives(scripts).select("content").mapInPandas(run, "path string"), "archives")
