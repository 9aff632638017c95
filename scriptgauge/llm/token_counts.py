"""Token counts by rank-synchronous array merging.

A text is cut where no piece of the vocabulary can reach across, so that its
pre-tokens are independent. The distinct pre-tokens of a batch lie behind one
another in flat numpy arrays; every round finds each sequence's best pair (lowest
rank, leftmost on ties) and merges all of them at once, until no pair is left.
The symbols that survive are the tokens. Nothing is shuffled.

Defined results: a null text counts as empty; an empty text has no token; a code
point outside the vocabulary counts its UTF-8 bytes (byte fallback). Rows are kept
one to one, repeated rows and null ids included.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptgauge.llm.common import slices

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NO_RANK = np.int64(2**40)
#: Distinct pre-tokens that a worker remembers between batches.
REMEMBERED = 300_000
#: A sequence of more symbols is merged by itself from a heap, which takes fewer steps than a round per merge.
LONG_SEQUENCE = 400


@dataclass
class PieceTable:
    """A BPE vocabulary with byte fallback: symbols by piece, and each mergeable pair with its rank."""

    symbols: dict[str, int]
    byte_ids: list[int]
    pair_keys: np.ndarray
    pair_to: np.ndarray
    pair_rank: np.ndarray

    @classmethod
    def load(cls, path: str) -> PieceTable:
        """Reads a .model file on the driver; the table is as large as the vocabulary, whatever the corpus."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        symbols, score, byte_ids = {}, {}, [0] * 256
        for i in range(model.vocab_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                symbols[model.id_to_piece(i)] = i
                score[i] = model.get_score(i)
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = []
        for piece, i in symbols.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, i, rank[score[i]]))
        pairs.sort()
        keys, to, ranks = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        return cls(symbols, byte_ids, keys, to, ranks)

    def start(self, sequence: str) -> list[int]:
        """One symbol per code point; below zero, -n stands for n bytes of a code point that no piece has."""
        get = self.symbols.get
        return [s if (s := get(c)) is not None else -len(c.encode("utf-8", "surrogatepass")) for c in sequence]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging neighbours; NO_RANK where they make no piece."""
        if not len(self.pair_keys):
            return np.full(len(left), NO_RANK), np.zeros(len(left), np.int64)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_rank[at], NO_RANK), self.pair_to[at]


def merge_all(table: PieceTable, sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that survive, of all sequences behind one another, and the number of each sequence's."""
    starts = [table.start(s) for s in sequences]
    lengths = np.array([len(s) for s in starts], dtype=np.int64)
    short = np.flatnonzero(lengths <= LONG_SEQUENCE)
    done = [(np.full(len(x), i), x) for i in np.flatnonzero(lengths > LONG_SEQUENCE) for x in (merge_long(table, starts[i]),)]
    flat = np.fromiter((x for i in short for x in starts[i]), dtype=np.int64, count=int(lengths[short].sum()))
    owner = np.repeat(short, lengths[short])
    while len(flat):
        begins = np.append(True, owner[1:] != owner[:-1])
        rank, to = table.look_up(flat, np.append(flat[1:], 0))
        rank[np.append(begins[1:], True)] = NO_RANK
        first = np.flatnonzero(begins)
        best = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(flat)))
        going = best < NO_RANK
        if not going.all():
            live = np.repeat(going, sizes)
            done.append((owner[~live], flat[~live]))
            flat, owner, rank, to = flat[live], owner[live], rank[live], to[live]
            sizes, best = sizes[going], best[going]
            if not len(flat):
                break
        hits = np.flatnonzero(rank == np.repeat(best, sizes))
        hits = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])]  # the leftmost of each sequence
        flat[hits] = to[hits]
        keep = np.ones(len(flat), dtype=bool)
        keep[hits + 1] = False
        flat, owner = flat[keep], owner[keep]
    owners, symbols = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *done, strict=True))
    order = np.argsort(owners, kind="stable")
    return symbols[order], np.bincount(owners, minlength=len(sequences))


def merge_long(table: PieceTable, symbols: list[int]) -> np.ndarray:
    """The same merges for one long sequence, taken from a heap of (rank, place)."""
    n = len(symbols)
    flat = np.array(symbols, dtype=np.int64)
    ranks, to = table.look_up(flat[:-1], flat[1:])
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(int(r), i, symbols[i], symbols[i + 1], int(t)) for i, (r, t) in enumerate(zip(ranks, to, strict=True)) if r < NO_RANK]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and symbols[i] >= 0 and symbols[j] >= 0:
            key = symbols[i] << 32 | symbols[j]
            at = int(np.searchsorted(table.pair_keys, key))
            if at < len(table.pair_keys) and table.pair_keys[at] == key:
                heapq.heappush(heap, (int(table.pair_rank[at]), i, symbols[i], symbols[j], int(table.pair_to[at])))

    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], alive[j], after[i] = merged, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return np.array([s for s, a in zip(symbols, alive, strict=True) if a], dtype=np.int64)


def survivors(table: PieceTable, sequences: list[str]) -> list[int]:
    """How many tokens each sequence ends up as."""
    symbols, sizes = merge_all(table, sequences)
    return np.add.reduceat(np.append(np.where(symbols < 0, -symbols, 1), 0), np.append(0, np.cumsum(sizes))[:-1]).tolist() if len(sequences) else []


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Appends the number of tokens of each text, without begin or end tokens, to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(PieceTable.load(model_path))
    kept = [c for c in docs.columns if c != into]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value, {}
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                rows = [SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
                new = list(set().union(*rows).difference(known))
                known.update(zip(new, survivors(table, new), strict=True))
                counts = pa.array([sum(map(known.__getitem__, r)) for r in rows], type=pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, counts], names=[*part.schema.names, into])
                if len(known) > REMEMBERED:
                    known.clear()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{schema}, `{into}` bigint")
