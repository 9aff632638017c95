"""Near-duplicate lines across a corpus: a segment-partition edit-distance join.

Lines whose edit distance is within a threshold (one edit per CHARS_PER_EDIT
characters of the shorter line, MAX_EDITS at most) are linked, and equal lines are
one node from the start. A line split into threshold-plus-one segments keeps one of
them whole under so many edits. So every line is indexed by its segments, and probes
for the segments of lines as long as itself or a little shorter, at the few places
where they can have moved to. Signatures are hashes, so no text is shuffled to find
candidates; their texts are then compared by a banded bit-parallel edit distance.

Defined results: lines are what lies between line feeds; lines of white space only
are never duplicates. The first place of a class (by id, then line number; null ids
last) keeps the line. Repeated rows with equal id and text are one document. Null
and empty texts have no lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptgauge.llm.common import settled, slices
from scriptgauge.llm.components import connected_components

MAX_EDITS, CHARS_PER_EDIT = 2, 20
#: Candidate lines up to this number are sent to the scan that fetches their texts; more are joined by shuffle.
BROADCAST_LINES = 500_000
LAST = 2**63 - 1
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
PAIRS = 4096
#: Characters of lines whose signatures are computed together, and an odd number whose powers weigh them.
CHUNK_CHARS, BASE = 30_000, 0xD1342543DE82EF95


def edits_allowed(length: int) -> int:
    return min(MAX_EDITS, length // CHARS_PER_EDIT)


@lru_cache(maxsize=100_000)
def segments(length: int) -> tuple[tuple[int, int], ...]:
    """Start and length of the threshold-plus-one segments of a line of this length."""
    parts = edits_allowed(length) + 1
    short, longer = divmod(length, parts)
    sizes = [short] * (parts - longer) + [short + 1] * longer
    return tuple((sum(sizes[:i]), s) for i, s in enumerate(sizes))


@lru_cache(maxsize=100_000)
def probes(length: int) -> tuple[tuple[int, int, int, int], ...]:
    """(indexed length, segment, start, size) of the substrings that can match a segment of a line not longer than this one."""
    out = []
    for indexed in range(max(CHARS_PER_EDIT, length - MAX_EDITS), length + 1):
        edits, shift = edits_allowed(indexed), length - indexed
        if shift > edits:
            continue
        for i, (start, size) in enumerate(segments(indexed)):
            low = max(start - i, start + shift - (edits - i), 0)
            high = min(start + i, start + shift + (edits - i), length - size)
            out += [(indexed, i, at, size) for at in range(low, high + 1)]
    return tuple(out)


@lru_cache(maxsize=20_000)
def cuts(length: int, indexed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and seed (indexed length and segment) of the substrings that a line of this length is indexed by or probes with."""
    own = [(length, i, at, size) for i, (at, size) in enumerate(segments(length))] if indexed else probes(length)
    return tuple(np.array(x, dtype) for x, dtype in (([at for _, _, at, _ in own], np.int64), ([n for *_, n in own], np.int64), ([size * 8 + i for size, i, _, _ in own], np.uint64)))


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2^64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, base, np.uint64))) for base in (BASE, pow(BASE, -1, 1 << 64)))


def substring_keys(text: str, at: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hashes of substrings, wherever they stand: differences of sums over the text's mixed characters times powers."""
    mixed = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    power, back = powers(1 << max(15, len(mixed).bit_length()))
    mixed += np.uint64(1)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= power[: len(mixed)]
    sums = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    keys = (sums[at + sizes] - sums[at]) * back[at] + seeds * np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(32)
    keys *= np.uint64(0xC2B2AE3D27D4EB4F)
    keys ^= keys >> np.uint64(29)
    return keys


def chunks(lines: list[str]) -> Iterator[list[str]]:
    """The lines in runs of CHUNK_CHARS characters at most; a longer line is a run of its own."""
    start, size = 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size > CHUNK_CHARS and i > start:
            yield lines[start:i]
            start, size = i, len(line)
    if start < len(lines):
        yield lines[start:]


def line_keys(lines: list[str], indexed: bool) -> tuple[np.ndarray, list[int]]:
    """Signatures of all the lines, one line's after the other, and how many each has."""
    found = [cuts(len(x), indexed) for x in lines]
    sizes = [len(x[0]) for x in found]
    at, lengths, seeds = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(lines) == 1 and len(lines[0]) > CHUNK_CHARS:  # parts of a long line, so that memory does not grow with it
        return np.array([_long_key(lines[0], a, n, s) for a, n, s in zip(at.tolist(), lengths.tolist(), seeds.tolist(), strict=True)], dtype=np.uint64), sizes
    starts = np.append(0, np.cumsum([len(x) for x in lines]))[:-1]
    return substring_keys("".join(lines), at + np.repeat(starts, sizes), lengths, seeds), sizes


def _long_key(line: str, at: int, size: int, seed: int) -> int:
    from xxhash import xxh64_intdigest

    if seed // 8 > CHUNK_CHARS:  # the indexed line is as long
        return xxh64_intdigest(line[at : at + size].encode("utf-8", "surrogatepass"), seed)
    return int(substring_keys(line[at : at + size], np.zeros(1, np.int64), np.array([size]), np.array([seed], dtype=np.uint64))[0])


def signatures(docs: DataFrame, indexed: bool, text: str = "text") -> DataFrame:
    """``(key, h, n)`` of every line long enough for an edit: its hashed segments, or the substrings that it probes with.

    ``h`` is the line's hash, ``n`` how often it stands in the texts that a task looked at together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                counts = Counter(x for t in part.column(0).to_pylist() if t for x in t.split("\n") if len(x) >= CHARS_PER_EDIT)
                found = [x for x in counts if VISIBLE.search(x)]
                for chosen in (found[i : i + 2000] for i in range(0, len(found), 2000)):
                    each = [line_keys(x, indexed) for x in chunks(chosen)]
                    keys, sizes = np.concatenate([k for k, _ in each]), [n for _, x in each for n in x]
                    hashes = np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in chosen], dtype=np.uint64).view(np.int64)
                    times = np.array([counts[x] for x in chosen])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(hashes, sizes)), pa.array(np.repeat(times, sizes))], names=["key", "h", "n"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "key long, h long, n long")


def gram_parity(lines: list[str], size: int, words: int = 1) -> np.ndarray:
    """``(words, lines)``: 64 parities a word of each line's hashed runs of ``size`` characters, ends included.

    An edit takes and brings ``size`` runs at most, so it turns ``2 * size`` bits at most.
    """
    if not lines:
        return np.zeros((words, 0), np.int64)
    ends = "\n" * max(1, size - 1)  # no run reaches into the line before
    starts = np.append(0, np.cumsum(np.array([len(x) + len(ends) for x in lines], dtype=np.int64)))[:-1]
    flat = np.frombuffer("".join(x + ends for x in lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    mixed = flat.copy()
    for back in range(1, size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.append(np.full(back, 10, np.uint64), flat[:-back])
    mixed = mixed * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    bits, word = np.uint64(1) << (mixed >> np.uint64(58)), (mixed >> np.uint64(40)) % np.uint64(words)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == w, bits, np.uint64(0)), starts).view(np.int64) for w in range(words)])


def pair_parity(lines: list[str]) -> np.ndarray:
    """64 parities of each line's hashed character pairs; an edit takes and brings two pairs at most, so it turns four bits at most."""
    return gram_parity(lines, 2)[0]


#: What is known of a line without its text: words of parities of its runs of so many characters, and its length.
PARITY_WORDS = {1: 1, 2: 4, 3: 4}
PARITIES = [f"g{size}_{w}" for size, words in PARITY_WORDS.items() for w in range(words)]
OUTLINE = f"struct<{','.join(f'{p}:bigint' for p in PARITIES)},length:int>"


def outlines(lines: list[str]) -> pa.Array:
    parities = [pa.array(word) for size, words in PARITY_WORDS.items() for word in gram_parity(lines, size, words)]
    return pa.StructArray.from_arrays([*parities, pa.array([len(x) for x in lines], pa.int32())], names=[*PARITIES, "length"])


def may_link(x: str = "bits_x", y: str = "bits_y") -> str:
    """SQL: whether two outlines allow the edits that lines of these lengths may differ by; true where one is not known."""
    edits = f"least({MAX_EDITS}, least({x}.length, {y}.length) div {CHARS_PER_EDIT})"
    turned = [f"{' + '.join(f'bit_count({x}.g{n}_{w} ^ {y}.g{n}_{w})' for w in range(words))} <= {2 * n} * {edits}" for n, words in PARITY_WORDS.items()]
    return f"coalesce(abs({x}.length - {y}.length) <= {edits} and {' and '.join(turned)}, true)"


def within(left: list[str], right: list[str], edits: np.ndarray) -> np.ndarray:
    """Whether each pair's edit distance is at most its ``edits`` (1 to 30): bit-parallel over a diagonal band.

    Bit ``edits + o`` of a pair's words is the row ``o`` below the diagonal of the
    current column; a step moves the band down one row.
    """
    swap = [len(a) > len(b) for a, b in zip(left, right, strict=True)]
    rows = [np.frombuffer((b if s else a).encode("utf-32-le", "surrogatepass"), dtype="<u4") for a, b, s in zip(left, right, swap, strict=True)]
    columns = [np.frombuffer((a if s else b).encode("utf-32-le", "surrogatepass"), dtype="<u4") for a, b, s in zip(left, right, swap, strict=True)]
    n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (rows, columns))
    result = (n == 0) & (m <= edits)
    live = np.flatnonzero((n > 0) & (m - n <= edits))
    flat_rows, flat_columns = (np.concatenate([*side, np.zeros(1, "<u4")]) for side in (rows, columns))
    row_at, column_at = (np.append(0, np.cumsum(x))[:-1] for x in (n, m))
    k = edits.astype(np.int64)
    one = np.uint64(1)
    plus, minus, distance = np.zeros(len(left), np.uint64), np.zeros(len(left), np.uint64), np.minimum(n, k)
    plus[:] = ((one << (k + 1).astype(np.uint64)) - one) << k.astype(np.uint64)  # the rows from the diagonal down to the band's end rise by one
    step = 0
    while len(live):
        over = live[m[live] <= step]
        if len(over):
            result[over] = distance[over] <= k[over]
            live = live[m[live] > step]
            if not len(live):
                break
        width = k[live]
        letter = flat_columns[column_at[live] + step]
        match = np.zeros(len(live), np.uint64)
        for o in range(-int(width.max()), int(width.max()) + 1):
            row = step + o
            inside = (row >= 0) & (row < n[live]) & (abs(o) <= width)
            same = inside & (flat_rows[np.where(inside, row_at[live] + row, 0)] == letter)
            match |= same.astype(np.uint64) << np.where(inside, o + width, 0).astype(np.uint64)
        p, q = plus[live], minus[live]
        full = (one << (2 * width + 1).astype(np.uint64)) - one
        diagonal = ((((match & p) + p) ^ p) | match | q) & full
        rise, fall = (q | ~(diagonal | p)) & full, diagonal & p
        bottom = n[live] - 1 - step  # how far below the diagonal the last row lies
        before_last = bottom >= width
        last_bit = np.where(before_last, 2 * width, width + bottom).astype(np.uint64)
        hit = lambda bits: ((bits >> last_bit) & one).astype(np.int64)
        distance[live] += np.where(before_last, 1 - hit(diagonal), hit(rise) - hit(fall))
        down = diagonal >> one
        plus[live], minus[live] = (fall | ~(down | rise)) & full, down & rise
        step += 1
        if step % 16 == 0:  # a value can fall by one in each column that is left after the last row has entered the band
            live = live[distance[live] <= k[live] + np.minimum(2 * k[live], m[live] - n[live] + k[live])]
    return result


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, mark, line_no, line, key, h)`` of every visible line; ``mark`` and id tell documents apart."""
    split = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("mark"), F.posexplode(F.split(f"`{text}`", "\n")).alias("line_no", "line"))
    return split.where(F.col("line").rlike(VISIBLE.pattern)).withColumn("key", F.unhex(F.md5("line"))).withColumn("h", F.xxhash64("line"))


def _place() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "line_no", "mark")


def verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``pairs(x, y)`` of line hashes: the links ``(a, b)`` between keys of lines within the threshold, and the lines ``(key, h, bits)``."""
    ids = settled(pairs.select(F.explode(F.array("x", "y")).alias("h")).distinct(), "line-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_LINES else ids
    found = line_table(docs, doc_id, text).select("key", "h", "line").join(wanted, "h").dropDuplicates(["key"]).select("key", "h", "line")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "line"):
                yield pa.RecordBatch.from_arrays([*part.columns, outlines(part.column(2).to_pylist())], names=["key", "h", "line", "bits"])

    texts = settled(found.mapInArrow(mark, f"key binary, h long, line string, bits {OUTLINE}"), "line-texts")
    sides = [texts.select(F.col("h").alias(h), F.col("key").alias(k), F.col("line").alias(t)) for h, k, t in (("x", "a", "left"), ("y", "b", "right"))]
    both = pairs.join(sides[0], "x").join(sides[1], "y").select("a", "b", "left", "right").where("abs(length(left) - length(right)) <= " + str(MAX_EDITS))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAIRS):
                part = batch.slice(start, PAIRS)
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                edits = np.array([edits_allowed(min(len(x), len(y))) for x, y in zip(left, right, strict=True)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(within(left, right, edits)))

    return settled(both.mapInArrow(verify, "a binary, b binary"), "line-links"), texts.select("key", "h", "bits")


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(a, b)``: keys of lines within the threshold, enough of them to connect every class.

    Lines that share a signature meet its most frequent owner first. Only those that
    this leaves in different classes meet each other, and of those only pairs whose
    lengths and parities (of characters, pairs and triples of them) allow so few edits:
    large groups of variants of one line, and of lines that share only a part, cost no
    comparison per pair.
    """
    owners = signatures(docs, True, text).groupBy("key", "h").agg(F.sum("n").alias("n")).groupBy("key").agg(F.max(F.struct("n", "h"))["h"].alias("hub"), F.count("*").alias("owners"))
    met = settled(signatures(docs, False, text).select("key", "h").join(owners, "key").where("owners > 1 or h <> hub").distinct(), "line-meetings")
    first, lines = verified(settled(_unordered(met.where("h <> hub"), "h", "hub"), "line-pairs"), docs, doc_id, text)
    roots = lines.join(connected_components(first), F.col("key") == F.col("node"), "left").groupBy("h").agg(F.min(F.coalesce("component", "key")).alias("root"), F.when(F.count("*") == 1, F.min("bits")).alias("bits"))
    classed = met.where("owners > 1").select("key", "h").join(roots, "h", "left").select("key", "h", F.coalesce("root", F.unhex(F.hex("h"))).alias("root"), "bits")
    classed = settled(classed, "line-classes")
    sides = [classed.select("key", F.col("h").alias(x), F.col("root").alias(f"root_{x}"), F.col("bits").alias(f"bits_{x}")) for x in ("x", "y")]
    # of lines whose hashes are not their own, no outline is known
    others = sides[0].join(sides[1], "key").where(f"x < y and root_x <> root_y and {may_link()}")
    second, _ = verified(settled(_unordered(others, "x", "y"), "line-pairs"), docs, doc_id, text)
    return first.unionAll(second)


def _unordered(frame: DataFrame, x: str, y: str) -> DataFrame:
    return frame.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y")).distinct()


def line_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, mark, line_no, class_doc_id, class_line_no, kept)`` of every visible line.

    The class is named by its first place.
    """
    lines = line_table(docs, doc_id, text)
    nodes = settled(lines.groupBy("key").agg(F.min(_place()).alias("place")), "lines")
    near = links(docs, doc_id, text)
    reach = connected_components(near).withColumnRenamed("node", "key")
    roots = nodes.join(reach, "key", "left").withColumn("root", F.coalesce("component", "key"))
    first = roots.groupBy("root").agg(F.min("place").alias("first"))
    told = roots.join(first, "root").select("key", "first")
    out = lines.select("doc_id", "mark", "line_no", "key").join(told, "key")
    return out.select("doc_id", "mark", "line_no", F.nullif(F.col("first.doc_id"), F.lit(LAST)).alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), (_place() == F.col("first")).alias("kept"))


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without lines that are near an earlier line; documents that lose all their lines go."""
    gone = line_classes(docs, doc_id, text).where("not kept").groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_set("line_no").alias("__gone"))
    marked = docs.withColumn("__doc_mark", F.xxhash64(f"`{text}`"))
    both = marked.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__doc_mark") == F.col("__mark")), "left")
    places = F.split(f"`{text}`", "\n")
    left = F.filter(places, lambda x, i: ~F.array_contains("__gone", i))
    both = both.withColumn("__left", F.when(F.col("__gone").isNotNull(), F.array_join(left, "\n")))
    keep = both.where(F.col("__gone").isNull() | F.col("__left").rlike(VISIBLE.pattern))
    return keep.select(*[F.coalesce("__left", f"`{c}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
