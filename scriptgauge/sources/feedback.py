"""Feedback entries kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
FIELDS = (
    "feedbackType", "contentDescription", "content", "dialect", "comments", "filePath", "originalFilename",
    "contactPerson", "contactInfo",
)
SCHEMA = ", ".join(f"{name} string" for name in (*FIELDS, CORRUPT))


def parse(lines: DataFrame) -> DataFrame:
    """``line`` to fields by a fixed schema; a broken line keeps its text in ``_corrupt_record``."""
    parsed = F.from_json("line", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.withColumn("f", parsed).select("line_no", "ts", "f.*")


def valid(lines: DataFrame) -> DataFrame:
    return parse(lines).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantine(lines: DataFrame) -> DataFrame:
    return parse(lines).filter(F.col(CORRUPT).isNotNull()).select("line_no", "ts", F.col(CORRUPT).alias("line"))


def migrate(lines: DataFrame) -> DataFrame:
    """Entries with the old ``content`` field get ``contentDescription``."""
    entries = valid(lines)
    return entries.withColumn("contentDescription", F.coalesce("contentDescription", "content")).drop("content")


def scan(lines: DataFrame) -> DataFrame:
    """Entries with the extension of the uploaded file and the name under which it is stored."""
    extension = F.concat(F.lit("."), F.element_at(F.split("originalFilename", r"\."), -1))
    return (
        migrate(lines)
        .withColumn("extension", F.when(F.col("originalFilename").contains("."), extension).otherwise(""))
        .withColumn(
            "stored_name", F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("_"), F.col("line_no").cast("string"), F.col("extension"))
        )
    )


def latest(lines: DataFrame) -> DataFrame:
    """Newest first."""
    return migrate(lines).orderBy(F.desc("ts"), F.asc("line_no"))


def append(entries: DataFrame, path: str) -> None:
    """Add entries as JSON lines; an append never rewrites what is there."""
    entries.write.mode("append").json(path)


def with_script(lines: DataFrame, scripts: DataFrame, folder: str) -> DataFrame:
    """Entries with the stored script they point to; paths outside ``folder``, or that climb out of it, are refused.

    All columns of ``scripts`` but the path come along, so pass only what is needed.
    """
    entries = migrate(lines).filter(F.col("filePath").startswith(folder) & ~F.col("filePath").rlike(r"(^|[/\\])\.\.([/\\]|$)"))
    return entries.join(scripts.withColumnRenamed("path", "filePath"), "filePath")
