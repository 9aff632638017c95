"""Byte-level BPE encoding and decoding by replaying merges over a whole corpus share.

A task cuts its texts into pre-tokens and numbers the distinct ones. Their bytes lie
behind one another in flat arrays with links to both neighbours, and an inverted
index holds, for each rank, the places of the token pairs that merge into it. The
merges are then applied in rank order, each to all of its places at once; only the
neighbours of a merged place get a new rank and a new entry in the index. Texts take
their ids from the numbered pre-tokens, so that every distinct pre-token of a share
is encoded once. Decoding gathers the tokens' bytes by id. Nothing is shuffled, and a
lost task repeats its own share only.

The result equals encoding each pre-token alone (lowest rank first, leftmost on
ties): merges of one rank in one pre-token are taken from the left, and a merge that
makes a pair of an earlier rank, where the order of places could matter, sends its
pre-token to :func:`encode_alone`. A pre-token that is itself in the vocabulary is
that token.

Defined results: a null or empty text has no ids and decodes to no bytes; null ids
decode to null. Rows stay one to one, repeated rows and null document ids included; a
column with the name of the result is replaced. One text is one row and so one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptgauge.llm.common import slices

NONE = np.int32(2**31 - 1)
#: Code points of text, and pre-tokens not met before, that a task holds before it replays the merges.
SHARE_CHARS, SHARE_WORDS = 8_000_000, 100_000
#: Distinct pre-tokens that a task remembers from one share to the next.
REMEMBERED = 200_000
#: Bytes of text that are cut at once.
CUT_BYTES = 1_000_000
#: Ids that are decoded at once.
DECODE_IDS = 1_000_000


@dataclass
class Ranks:
    """A vocabulary: tokens by rank, the rank of each byte, and each pair of tokens that makes a token."""

    tokens: list[bytes]
    by_bytes: dict[bytes, int]
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray

    @classmethod
    def load(cls, path: str) -> Ranks:
        """Reads ``base64 rank`` lines on the driver; the table is as large as the vocabulary, whatever the corpus."""
        by_bytes = {}
        with open(path, "rb") as source:
            for line in source:
                if parts := line.split():
                    by_bytes[base64.b64decode(parts[0])] = int(parts[1])
        tokens = [b""] * (max(by_bytes.values()) + 1)
        pairs = []
        for token, rank in by_bytes.items():
            tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = by_bytes.get(token[:cut]), by_bytes.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank))
        pairs.sort()
        keys, ranks = zip(*pairs, strict=True) if pairs else ((), ())
        bytes_ = np.array([by_bytes[bytes([b])] for b in range(256)], dtype=np.int32)
        return cls(tokens, by_bytes, bytes_, np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int32))

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the two make no token."""
        if not len(self.pair_keys):
            return np.full(len(left), NONE)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)


def encode_alone(ranks: Ranks, word: bytes) -> list[int]:
    """The ids of one pre-token: the pair of the lowest rank merges, the leftmost on ties, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.by_bytes.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
        if rank == NONE:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks.by_bytes[p] for p in parts]


def replay(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words behind one another, and how many each word has."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    symbol = np.append(ranks.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)], np.int32(0))
    n = len(symbol) - 1
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.cumsum(sizes)[sizes > 0]
    after[ends - 1] = n
    before[(ends - sizes[sizes > 0])] = -1
    alive, odd = np.ones(n, dtype=bool), np.zeros(len(words), dtype=bool)
    rank_at = np.where(after[:n] < n, ranks.of_pairs(symbol[:n], symbol[np.minimum(after[:n], n)]), NONE)
    index: list[list[np.ndarray] | None] = [None] * len(ranks.tokens)

    def enter(places: np.ndarray) -> None:
        own = rank_at[places]
        order = np.argsort(own, kind="stable")
        places, own = places[order], own[order]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(own)]
        for a, b in pairwise(bounds):
            r = own[a]
            if index[r] is None:
                index[r] = [places[a:b]]
            else:
                index[r].append(places[a:b])

    start = np.flatnonzero(rank_at != NONE)
    if len(start):
        enter(start)
    for rank in range(len(index)):
        if index[rank] is None:
            continue
        at, index[rank] = np.concatenate(index[rank]), None
        at = np.sort(at[rank_at[at] == rank])
        if not len(at):
            continue
        linked = after[at[:-1]] == at[1:]
        if linked.any():  # places that overlap: every second one of a chain merges
            nth = np.arange(len(at))
            heads = np.append(True, ~linked)
            at = at[(nth - np.maximum.accumulate(np.where(heads, nth, 0))) % 2 == 0]
        gone = after[at]
        following = after[gone]
        symbol[at], after[at] = rank, following
        inner = following < n
        before[following[inner]] = at[inner]
        alive[gone] = False
        rank_at[gone] = NONE
        previous = before[at]
        touched = np.sort(np.concatenate([at, previous[previous >= 0]]))
        touched = touched[np.append(True, touched[1:] != touched[:-1])]
        right = after[touched]
        found = np.where(right < n, ranks.of_pairs(symbol[touched], symbol[right]), NONE)
        rank_at[touched] = found
        if (early := found < rank).any():
            odd[owner[touched[early]]] = True
        if len(new := touched[(found != NONE) & (found > rank)]):
            enter(new)
    left = np.bincount(owner[alive], minlength=len(words))
    ids = symbol[:n][alive]
    alone = {i: encode_alone(ranks, words[i]) for i in np.flatnonzero(odd).tolist()}
    alone |= {i: [whole] for i, w in enumerate(words) if left[i] > 1 and (whole := ranks.by_bytes.get(w)) is not None}
    if not alone:
        return ids, left
    parts, done, cuts = [], 0, np.append(0, np.cumsum(left))
    for i, own in sorted(alone.items()):
        parts += [ids[cuts[done] : cuts[i]], np.array(own, dtype=np.int32)]
        left[i], done = len(own), i + 1
    return np.concatenate([*parts, ids[cuts[done] :]]), left


class Encoder:
    """Numbers the pre-tokens it meets and keeps their ids; texts wait as number sequences until the next replay."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.cut = ranks, regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.lists = pa.array([], pa.list_(pa.int32()))

    def numbers(self, text: str | None) -> np.ndarray:
        words, known = self.cut(text or ""), self.known
        for w in set(words).difference(known):
            known[w] = len(known)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))

    @property
    def waiting(self) -> int:
        return len(self.known) - len(self.lists)

    def ids(self, texts: list[np.ndarray]) -> pa.ListArray:
        """The ids of each text, after a replay over the pre-tokens that have none yet."""
        if self.waiting:
            new = list(self.known)[len(self.lists) :]
            flat, sizes = replay(self.ranks, [w.encode("utf-8") for w in new])
            told = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
            self.lists = pa.concat_arrays([self.lists, told])
        words = np.concatenate([*texts, np.zeros(0, np.int32)])
        counts = np.diff(self.lists.offsets.to_numpy())[words] if len(words) else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.lists.take(pa.array(words)).flatten())

    def forget(self) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.lists = {}, self.lists.slice(0, 0)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Appends the ids of each text, ``array<int>``, to the kept columns (all by default)."""
    shared = docs.sparkSession.sparkContext.broadcast(Ranks.load(path))
    kept = [c for c in (keep or docs.columns) if c != into]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        parts: list[pa.RecordBatch] = []
        rows: list[np.ndarray] = []
        chars = 0

        def told() -> Iterator[pa.RecordBatch]:
            done = 0
            for part in parts:
                yield pa.RecordBatch.from_arrays([*part.columns, encoder.ids(rows[done : done + part.num_rows])], names=[*part.schema.names, into])
                done += part.num_rows
            encoder.forget()

        for batch in batches:
            for part in slices(batch, "text", CUT_BYTES):
                texts = part.column(part.num_columns - 1).to_pylist()
                rows += map(encoder.numbers, texts)
                chars += sum(len(t) for t in texts if t)
                parts.append(part.select(part.schema.names[:-1]))
                if chars > SHARE_CHARS or encoder.waiting > SHARE_WORDS:
                    yield from told()
                    parts, rows, chars = [], [], 0
        yield from told()

    schema = ", ".join([f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(kept))] + [f"`{into}` array<int>"])
    return source.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col(f"`{into}`"))


def decode(frame: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Appends the bytes that the ids stand for, which need not be valid UTF-8 if the ids were cut."""
    shared = frame.sparkSession.sparkContext.broadcast(Ranks.load(path).tokens)
    kept = [c for c in frame.columns if c != into]
    source = frame.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)])
    place = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                lists = batch.column(place)
                sizes = np.cumsum(np.nan_to_num(lists.slice(start).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                rows = max(1, int(np.searchsorted(sizes, DECODE_IDS, "right")))
                part = batch.slice(start, rows)
                start += rows
                taken = tokens.take(part.column(place).flatten())
                _, offsets, data = taken.buffers()
                bounds = np.frombuffer(offsets, dtype=np.int64)[taken.offset :][np.append(0, sizes[:rows])] if len(taken) else np.zeros(rows + 1, np.int64)
                found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.ascontiguousarray(bounds)), data])
                found = pa.compute.if_else(part.column(place).is_null(), pa.scalar(None, pa.large_binary()), found).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, into])

    schema = ", ".join([f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(kept))] + [f"`{into}` binary"])
    return source.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col(f"`{into}`"))
