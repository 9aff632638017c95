"""Read scripts from tables and text files; bytes to text, ZIP archives to bytes and back."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

RECORD_END = "\x1e"
SCRIPT_SCHEMA = "script_id string, path string, dialect string, schema_name string, ts timestamp, src string"
# Charsets in the order they are tried; the last one accepts every byte
CHARSETS = ("utf-8", "gbk", "iso-8859-1")
MEMBER_SCHEMA = "archive string, member string, charset string, src string, error string"
TEXT_SCHEMA = "script_id string, charset string, src string"


def read_script_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SCRIPT_SCHEMA).format(fmt).load(path)


def read_sql_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``, any depth, with the file's path."""
    return (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("src"))
    )


def read_packed_files(spark: SparkSession, path: str) -> DataFrame:
    """Many scripts per file, each closed by a record separator: large files stay splittable."""
    return spark.read.option("lineSep", RECORD_END).text(path).select(F.col("value").alias("src"))


def write_packed_files(scripts: DataFrame, path: str) -> None:
    scripts.select("src").write.option("lineSep", RECORD_END).text(path)


def decode(data: bytes) -> tuple[str, str]:
    """Text and charset of the first charset that accepts all bytes."""
    for charset in CHARSETS:
        try:
            return data.decode(charset), charset
        except UnicodeDecodeError:
            continue
    raise ValueError("unreachable: the last charset accepts every byte")


def decode_texts(files: DataFrame) -> DataFrame:
    """(script_id, content) with raw bytes to text; only this step and ZIP reading leave the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [decode(bytes(content)) for content in batch["content"]]
            yield pd.DataFrame(
                {"script_id": batch["script_id"], "charset": [c for _, c in texts], "src": [t for t, _ in texts]}
            )

    return files.select("script_id", "content").mapInPandas(run, TEXT_SCHEMA)


def expand_archives(archives: DataFrame) -> DataFrame:
    """(path, content) of ZIP files to one row per ``.sql`` member. Members never touch the disk.

    An archive or a member that cannot be read is a row with its ``error`` and no text.
    """

    def members(path: str, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                for info in archive.infolist():
                    if not info.is_dir() and info.filename.lower().endswith(".sql"):
                        try:
                            text, charset = decode(archive.read(info))
                            yield path, info.filename, charset, text, None
                        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError) as error:
                            yield path, info.filename, None, None, str(error)
        except zipfile.BadZipFile as error:
            yield path, None, None, None, str(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for path, content in zip(batch["path"], batch["content"]) for row in members(path, content)]
            yield pd.DataFrame(rows, columns=["archive", "member", "charset", "src", "error"])

    return archives.select("path", "content").mapInPandas(run, MEMBER_SCHEMA)


#: Code points of scripts that go into one archive, beyond its last script. A few scripts each would be a million files to list at 6 GB.
ARCHIVE_CHARS = 4_000_000


def pack_archives(scripts: DataFrame) -> DataFrame:
    """(path, content): ZIPs of about ARCHIVE_CHARS of scripts, with a folder and a text file that readers must skip."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lot = batch["src"].str.len().cumsum() // ARCHIVE_CHARS
            for _, part in batch.groupby(lot, sort=False, dropna=False):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("in/", "")
                    archive.writestr("in/readme.txt", "SELECT 1 FROM skipped;")
                    for path, src in zip(part["path"], part["src"]):
                        archive.writestr(path, src.encode("utf-8"))
                yield pd.DataFrame({"path": [part["path"].iloc[0] + ".zip"], "content": [buffer.getvalue()]})

    return scripts.select("path", "src").mapInPandas(run, "path string, content binary")


def encode_texts(scripts: DataFrame) -> DataFrame:
    """(script_id, charset, src) to bytes in the named charset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = [src.encode(charset) for src, charset in zip(batch["src"], batch["charset"])]
            yield pd.DataFrame({"script_id": batch["script_id"], "content": content})

    return scripts.select("script_id", "charset", "src").mapInPandas(run, "script_id string, content binary")


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """One name per line; blanks trimmed, empty lines dropped."""
    return spark.read.text(path).select(T.trimmed(F.col("value")).alias("name")).filter(F.length("name") > 0)
