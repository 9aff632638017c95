"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum over all ways to cut it into pieces, which the
forward algorithm adds up along the word; a text's is the product over its words
(runs of letters, lower-cased). Training counts words per language in one
aggregation over all labelled rows, then re-estimates piece probabilities from the
expected counts of a forward-backward pass over the distinct words, a few times.
The model has as many numbers as the vocabulary has pieces, times the languages.

Defined results: a text that is null or has no letter is ``und`` with score 0, as
is everything where no language was learned. The score is the winner's posterior
when the evidence of a long text is scaled down to that of EVIDENCE_WORDS words.
Equal scores go to the language that comes first by code point. A word of more than
LONGEST letters is scored in stretches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptgauge.llm.common import settled, slices

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
START = "▁"
#: Letters of a stretch; probability of a code point outside the vocabulary and least one of a piece.
LONGEST, FLOOR = 40, 1e-7
PASSES, SMOOTHING, EVIDENCE_WORDS = 3, 0.1, 20.0
#: Words that a worker remembers or counts before it hands them on.
REMEMBERED, WORD_BATCH = 400_000, 20_000


def words_of(text: str | None) -> list[str]:
    found = LETTERS.findall(text.lower()) if text else []
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


#: What look-ups give for the beginning of a piece, and for anything else; base of the substring hashes.
BEGINS, ABSENT, FACTOR = -2, -3, np.uint64(0x9E3779B97F4A7C15)


@dataclass
class PieceIndex:
    """Hashes of all beginnings of pieces in order, with each piece's number or BEGINS."""

    keys: np.ndarray
    numbers: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[str]) -> PieceIndex:
        numbers = {p[:i]: BEGINS for p in pieces for i in range(1, len(p) + 1)} | {p: i for i, p in enumerate(pieces)}
        keys = {}
        for text, number in numbers.items():
            mark = 0
            for c in text:
                mark = (mark * int(FACTOR) + ord(c) + 1) & (2**64 - 1)
            keys[mark] = number
        order = sorted(keys)
        return cls(np.array(order, dtype=np.uint64), np.array([keys[k] for k in order], dtype=np.int64), max(map(len, pieces), default=0))

    def look_up(self, marks: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(marks), ABSENT)
        at = np.minimum(np.searchsorted(self.keys, marks), len(self.keys) - 1)
        return np.where(self.keys[at] == marks, self.numbers[at], ABSENT)


@dataclass
class Lattice:
    """All pieces inside a batch of words: an edge has its word, start, end and piece (-1: unknown code point)."""

    n_words: int
    width: int
    ends: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, words: list[str], pieces: PieceIndex) -> Lattice:
        """Substrings of all words grow together, one code point at a time, as long as they begin a piece."""
        ends = np.array([len(w) + 1 for w in words], dtype=np.int64)
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        first = np.append(0, np.cumsum(ends))[:-1]
        owner = np.repeat(np.arange(len(words)), ends)
        at, mark, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for length in range(1, pieces.longest + 1):
            inside = at + length <= (first + ends)[owner[at]]
            at, mark = at[inside], mark[inside]
            mark = mark * FACTOR + codes[at + length - 1] + np.uint64(1)
            number = pieces.look_up(mark)
            if length == 1:
                found.append((at[number < 0], length, np.full((number < 0).sum(), -1)))
            found.append((at[number >= 0], length, number[number >= 0]))
            at, mark = at[number > ABSENT], mark[number > ABSENT]
        place = np.concatenate([x for x, _, _ in found]) if found else np.zeros(0, np.int64)
        size = np.concatenate([np.full(len(x), n) for x, n, _ in found]) if found else np.zeros(0, np.int64)
        word = owner[place]
        start = place - first[word]
        return cls(len(words), int(ends.max(initial=0)), ends, word, start, start + size, np.concatenate([x for *_, x in found]) if found else place)

    def _steps(self, place: np.ndarray, chance: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of edges with one start and end, in order of ``place``: start, end, words (each once), chances."""
        key = (place * 64 + self.end - self.start).astype(np.int16)  # places are at most LONGEST + 1
        order = np.argsort(key, kind="stable")
        key, word, chance, start, end = key[order], self.word[order], chance[order], self.start[order], self.end[order]
        cuts = np.append(np.append(0, np.flatnonzero(np.diff(key)) + 1), len(key)) if len(key) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(start[a]), int(end[a]), word[a:b], chance[a:b]

    def forward(self, chance: np.ndarray) -> np.ndarray:
        """Sums over segmentations of each prefix, ``(positions, words, models)``; ``chance`` is ``(edges, models)``."""
        alpha = np.zeros((self.width + 1, self.n_words, chance.shape[1]))
        alpha[0] = 1.0
        for start, end, word, p in self._steps(self.end, chance):
            alpha[end][word] += alpha[start][word] * p
        return alpha

    def backward(self, chance: np.ndarray) -> np.ndarray:
        """The same for each suffix."""
        beta = np.zeros((self.width + 1, self.n_words, chance.shape[1]))
        beta[self.ends, np.arange(self.n_words)] = 1.0
        for start, end, word, p in self._steps(self.width - self.start, chance):
            beta[start][word] += beta[end][word] * p
        return beta


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    chance: np.ndarray  # (pieces + 1, languages); the last row is for unknown code points


def vocabulary(model_path: str) -> list[str]:
    """The pieces of a .model file, without control and byte pieces."""
    from scriptgauge.llm.token_counts import PieceTable

    return sorted(PieceTable.load(model_path).symbols)


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, word, n)`` over all rows with a language; counted in each batch before the shuffle."""
    source = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts: dict[str, Counter] = {}
                for lang_, text_ in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    counts.setdefault(lang_, Counter()).update(words_of(text_))
                for lang_, found in counts.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    return source.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", passes: int = PASSES) -> LanguageModel:
    """Learns from every row of ``docs`` that has a language."""
    counts = settled(word_counts(docs, text, lang), "language-words")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())  # one row per language
    chance = np.full((len(pieces) + 1, len(languages)), 1.0 / max(1, len(pieces)))
    context = docs.sparkSession.sparkContext
    names = context.broadcast((PieceIndex.of(pieces), {name: i for i, name in enumerate(languages)}))
    for _ in range(passes if languages else 0):
        now = context.broadcast(chance)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (numbers, places), chance_ = names.value, now.value
            total = np.zeros(chance_.shape)
            for batch in batches:
                for start in range(0, batch.num_rows, WORD_BATCH):
                    part = batch.slice(start, WORD_BATCH)
                    lattice = Lattice.of(part.column(1).to_pylist(), numbers)
                    place = np.array([places[x] for x in part.column(0).to_pylist()])
                    p = chance_[lattice.piece, place[lattice.word]][:, None]
                    alpha, beta = lattice.forward(p), lattice.backward(p)
                    whole = beta[0, :, 0]
                    share = alpha[lattice.start, lattice.word, 0] * p[:, 0] * beta[lattice.end, lattice.word, 0] / whole[lattice.word]
                    share *= np.array(part.column(2).to_pylist())[lattice.word]
                    total += np.bincount(np.where(lattice.piece < 0, total.shape[0] - 1, lattice.piece) * total.shape[1] + place[lattice.word], share, total.size).reshape(total.shape)
            total[-1] = 0
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(total[piece, language])], names=["piece", "language", "n"])

        expected = counts.mapInArrow(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros((len(pieces), len(languages)))
        table[expected["piece"].to_numpy(), expected["language"].to_numpy()] = np.round(expected["n"].to_numpy(), 3)
        table += SMOOTHING
        chance = np.vstack([np.maximum(table / table.sum(axis=0), FLOOR), np.full((1, len(languages)), FLOOR)])
    return LanguageModel(languages, pieces, chance)


def word_scores(words: list[str], numbers: PieceIndex, chance: np.ndarray) -> np.ndarray:
    """log P(word | language), ``(words, languages)``."""
    lattice = Lattice.of(words, numbers)
    alpha = lattice.forward(chance[lattice.piece])
    return np.log(alpha[lattice.ends, np.arange(len(words))])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Appends the predicted language and its score to every row; only the text is looked at."""
    kept = [c for c in docs.columns if c not in (label, score)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, PieceIndex.of(model.pieces), model.chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, numbers, chance = shared.value
        known: dict[str, int] = {}
        scores = np.zeros((0, len(languages)))
        for batch in batches:
            for part in slices(batch, text, 2_000_000):
                rows = [words_of(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                labels, values = [UNKNOWN] * len(rows), np.zeros(len(rows))
                if languages:
                    if len(known) > REMEMBERED:
                        known, scores = {}, scores[:0]
                    new = list(set().union(*rows).difference(known))
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    scores = np.vstack([scores, *(word_scores(new[i : i + WORD_BATCH], numbers, chance) for i in range(0, len(new), WORD_BATCH))])
                    for i, row in enumerate(rows):
                        if row:
                            total = scores[list(map(known.__getitem__, row))].sum(axis=0) * min(1.0, EVIDENCE_WORDS / len(row))
                            best = int(total.argmax())
                            labels[i], values[i] = languages[best], 1 / np.exp(total - total[best]).sum()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(values)], names=[*part.schema.names, label, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{schema}, `{label}` string, `{score}` double")


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row's id falls into the fold that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % folds == fold, F.lit(False))
