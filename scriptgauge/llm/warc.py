"""WARC archives with an index: write records, then read the selected ones by byte range.

``write_archives`` deals payloads out once, by their digest, and every task writes
archives of its own (one gzip member per record, as the format has it) to the shared
folder. What it yields is the index: file, offset, length, URL and digest of each
record. Only records in the committed index exist for a reader, so an archive left
by a lost or repeated task is never read. ``read_records`` sorts the selected
entries by file and offset, joins neighbours to one range read each, and checks
every payload against its digest. Folders are opened through pyarrow's file
systems, so object stores and HDFS work like a shared disk.

Defined results: a null payload is empty; of records with equal payloads of at
least ``min_bytes`` bytes the one with the largest id is the response and the
others revisit it; equal ids with that payload are all responses, as are records
of a payload that has no id at all. A null URL leaves out its header.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptgauge.llm.common import settled, slices
from scriptgauge.session import scratch_path

#: An archive is closed beyond this size.
ARCHIVE_BYTES = 256_000_000
#: Records of so long a stretch of an archive are read by one group; neighbours closer than a gap by one read.
STRETCH_BYTES, GAP_BYTES = 8_000_000, 65_536
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) has an empty block."""
    revisit = refers_to is not None
    block = b"" if revisit else HTTP_HEAD + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(fields: dict[str, str], name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)``; returns the committed index."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha1("html"))
    shared = keyed.where(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").select("key", "response_id")
    typed = keyed.join(shared.hint("shuffle_hash"), "key", "left").select("page_id", "url", "html", F.when(F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, path, at = None, "", 0
        for batch in batches:
            for part in slices(batch, "html"):
                rows = {c: [] for c in INDEX_COLUMNS}
                for row in part.to_pylist():
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        path, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{path}", compression=None)
                    payload = row["html"].encode("utf-8", "surrogatepass")
                    name, revisit = digest(payload), row["refers_to"] is not None
                    member = gzip.compress(record(row["page_id"], row["url"], payload, name, row["refers_to"], date), 3, mtime=0)
                    out.write(member)
                    for c, v in zip(INDEX_COLUMNS, (path, at, len(member), row["page_id"], row["url"], name, "revisit" if revisit else "response", row["refers_to"]), strict=True):
                        rows[c].append(v)
                    at += len(member)
                yield pa.RecordBatch.from_pydict(rows, schema=INDEX_SCHEMA)
        if out is not None:
            out.close()

    return settled(typed.mapInArrow(write, INDEX), "warc-index")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


INDEX_SCHEMA, RECORDS_SCHEMA = _arrow(INDEX), _arrow(RECORDS)
INDEX_COLUMNS = INDEX_SCHEMA.names


def ranges(entries: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Entries (offset, length) in order to reads (start, end, entries): neighbours within GAP_BYTES share one."""
    start, end, held = 0, 0, []
    for offset, length in entries:
        if held and offset > end + GAP_BYTES:
            yield start, end, held
            held = []
        start = offset if not held else start
        end = max(end, offset + length) if held else offset + length
        held.append((offset, length))
    if held:
        yield start, end, held


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the selected index rows, read back and checked; ``payloads`` adds the bytes."""
    schema = RECORDS + (", payload binary" if payloads else "")
    arrow = _arrow(schema)

    def read(group: pa.Table) -> pa.Table:
        files, base = pafs.FileSystem.from_uri(folder)
        entries = sorted(set(zip(group["offset"].to_pylist(), group["length"].to_pylist(), strict=True)))
        rows = {c: [] for c in arrow.names}
        with files.open_input_file(f"{base}/{group['file'][0].as_py()}") as source:
            for start, end, held in ranges(entries):
                stretch = memoryview(source.read_at(end - start, start))
                for offset, length in held:
                    fields, payload = parse(gzip.decompress(stretch[offset - start : offset - start + length]))
                    named = fields["warc-payload-digest"].removeprefix("sha1:")
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and digest(payload) != named:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    values = [_page(fields, "warc-record-id"), fields.get("warc-target-uri"), fields["warc-type"], _page(fields, "warc-refers-to"), named, None if revisit else len(payload), None if revisit else payload]
                    for c, v in zip(arrow.names, values, strict=False):
                        rows[c].append(v)
        return pa.table(rows, schema=arrow)

    wanted = index.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch"))
    return wanted.groupBy("file", "stretch").applyInArrow(read, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Gives every revisit the payload length of the response that it refers to."""
    responses = records.where("record_type = 'response'")
    known = responses.where("page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(known, ["refers_to", "payload_digest"])
    return responses.unionByName(revisits)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages to archives below the shared folder and returns what reading them back gives."""
    folder = scratch_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, min_bytes)
    return resolve_revisits(settled(read_records(index, folder), "warc-records"))
