"""Periodic runs of words, found on a grammar of each text.

A run is a stretch with smallest period q and length at least max(12, 2q) that no
neighbouring word extends. A task numbers the words of its texts and keeps only the
stretches that six-word windows occurring at least twice in the text cover: every
word of a run lies in such a window, whose other occurrence is one period away, so
no run leaves its stretch. Re-Pair then writes each stretch as a grammar, replacing
the most frequent pair of symbols (of equal counts the older) by a new nonterminal
until no pair is left twice; what remains is halved into a balanced tree of rules
that are used once.

A run lies whole in the smallest node of the derivation that holds it and crosses
that node's boundary between left and right part. So the stretches that cross the
boundary are computed once per nonterminal, from common extensions to both sides for
every period, and translated to all places where the nonterminal is derived.
Stretches of one period inside a longer one are merged into it; of equal intervals
the smallest period stays. Common extensions compare numbered blocks of 2^k words,
exactly: no hash decides a result.

Defined results: a null or empty text has no words and no runs; repeated rows are
rows like others; columns with the names of the results are replaced. One text is
one row and so one task; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptgauge.llm.common import slices

LEAST_LENGTH, WINDOW = 12, 6
#: Candidate (nonterminal, period) pairs that are extended at once.
CANDIDATES = 2_000_000


def re_pair(sequence: list[int], fresh: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Rules and the remaining symbols; rule number i makes symbol ``fresh + i``, terminals are below ``fresh``."""
    symbol, n = list(sequence), len(sequence)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        places.setdefault((symbol[i], symbol[i + 1]), []).append(i)
    heap = [(-len(p), age, pair) for age, (pair, p) in enumerate(places.items()) if len(p) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    age = len(places)
    while heap:
        count, old, pair = heapq.heappop(heap)
        left, right = pair
        found, live, taken = [], [], -1
        for i in places[pair]:
            if symbol[i] == left and (j := after[i]) < n and symbol[j] == right:
                live.append(i)
                if i != taken:  # of overlapping places of a pair of equal symbols every second one counts
                    found.append(i)
                    taken = j
        if len(found) < 2:
            del places[pair]
            continue
        if len(found) < -count:
            places[pair] = live
            heapq.heappush(heap, (-len(found), old, pair))
            continue
        new = fresh + len(rules)
        rules.append(pair)
        met: dict[tuple[int, int], list[int]] = {}
        for i in found:
            j = after[i]
            k, h = after[j], before[i]
            symbol[i], symbol[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
            if h >= 0:
                met.setdefault((symbol[h], new), []).append(h)
        for i in found:
            if (k := after[i]) < n and symbol[k] != new:
                met.setdefault((new, symbol[k]), []).append(i)
        del places[pair]
        for key, at in met.items():
            if len(at) > 1:
                places[key] = at
                heapq.heappush(heap, (-len(at), age, key))
                age += 1
    rest, i = [], 0
    while i < n:
        rest.append(symbol[i])
        i = after[i]
    return rules, rest


def repeated_stretches(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches covered by windows that occur twice in their text; windows of equal hashes count as equal."""
    ends = np.cumsum(sizes)
    n, owner = len(words), np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.arange(n) + WINDOW <= np.repeat(ends, sizes))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(WINDOW):
        mixed = (mixed ^ words[at + i].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    twice = at[order[np.append(False, same) | np.append(same, False)]]
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    first = covered & np.append(True, ~covered[:-1] | (owner[1:] != owner[:-1]))
    last = covered & np.append(~covered[1:] | (owner[1:] != owner[:-1]), True)
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = stops - starts >= LEAST_LENGTH
    return starts[long], stops[long]


class Blocks:
    """Numbers of all blocks of 2^k words: equal numbers are equal words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        while 2 ** len(self.names) <= longest:
            half, step = self.names[-1], 2 ** (len(self.names) - 1)
            if len(half) <= step:
                break
            self.names.append(np.unique(half[:-step] * (len(words) + 1) + half[step:], return_inverse=True)[1].astype(np.int64))

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from x and y on (or back from them, both included) agree, ``most`` at most."""
        done = np.zeros(len(x), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step = 2**k
            live = np.flatnonzero(done + step <= most)
            shift = done[live] if forward else -done[live] - step + 1
            name = self.names[k]
            done[live[name[x[live] + shift] == name[y[live] + shift]]] += step
        return done


def boundary_runs(blocks: Blocks, starts: np.ndarray, boundaries: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(node, start, end, period)`` of the stretches that cross each node's boundary, cut at the node's ends.

    A stretch of two periods holds a whole one on one side of the boundary: on the
    right the words from the boundary agree with those one period later, on the left
    likewise.
    """
    found = []
    half = (stops - starts) // 2
    for right in (True, False):
        most = np.minimum(half, stops - boundaries if right else boundaries - starts)
        cuts = np.searchsorted(np.cumsum(most), np.arange(0, max(1, int(most.sum())), CANDIDATES))
        for a, b in zip(cuts, [*cuts[1:], len(most)], strict=True):
            node = np.repeat(np.arange(a, b), most[a:b])
            period = np.arange(len(node)) - np.repeat(np.cumsum(most[a:b]) - most[a:b], most[a:b]) + 1
            b_at, words = boundaries[node], blocks.names[0]
            crossing = words[b_at - 1] == words[b_at - 1 + period] if right else words[b_at] == words[b_at - period]
            node, period, b_at = node[crossing], period[crossing], b_at[crossing]
            if right:
                back = blocks.common(b_at - 1, b_at - 1 + period, b_at - starts[node], False)
                ahead = np.minimum(period + blocks.common(b_at, np.minimum(b_at + period, stops[node] - 1), stops[node] - b_at - period, True), stops[node] - b_at)
            else:
                ahead = blocks.common(b_at, b_at - period, stops[node] - b_at, True)
                back = period + blocks.common(b_at - 1, np.maximum(b_at - 1 - period, 0), b_at - period - starts[node], False)
            ok = (back + ahead >= 2 * period) & (back + ahead >= LEAST_LENGTH)
            found.append((node[ok], (b_at - back)[ok], (b_at + ahead)[ok], period[ok]))
    node, start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start, node))
    node, start, end, period = node[order], start[order], end[order], period[order]
    first = np.append(True, (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(node)]
    return node[first], start[first], end[first], period[first]


def grammars(words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left and right symbols of all rules, the symbols' lengths, and ``(symbol, place)`` rows of the stretches' topmost symbols."""
    fresh = int(words.max()) + 1 if len(words) else 1
    left, right, tops = [], [], []
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        rules, rest = re_pair(words[a:b].tolist(), fresh)
        shift = len(left)
        left += [x if x < fresh else x + shift for x, _ in rules]
        right += [y if y < fresh else y + shift for _, y in rules]
        level = [x if x < fresh else x + shift for x in rest]
        while len(level) > 1:  # what is left has no repeated pair: a balanced tree of rules that are used once
            pairs = list(zip(level[::2], level[1::2], strict=False))
            made = list(range(fresh + len(left), fresh + len(left) + len(pairs)))
            left += [x for x, _ in pairs]
            right += [y for _, y in pairs]
            level = made + level[2 * len(pairs) :]
        tops.append((level[0], a))
    lengths = [1] * len(left)
    size = lambda s: 1 if s < fresh else lengths[s - fresh]
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        lengths[i] = size(x) + size(y)
    rows = np.array(tops, dtype=np.int64).reshape(-1, 2)
    rows[:, 0] -= fresh
    return np.array(left, dtype=np.int64) - fresh, np.array(right, dtype=np.int64) - fresh, np.array(lengths, dtype=np.int64), rows


def derived(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rule, place)`` of every node of the derivation trees that is long enough for a run."""
    rules, places, symbol, place = [], [], tops[:, 0], tops[:, 1]
    while len(symbol):
        keep = symbol >= 0
        symbol, place = symbol[keep], place[keep]
        keep = lengths[symbol] >= LEAST_LENGTH
        symbol, place = symbol[keep], place[keep]
        rules.append(symbol)
        places.append(place)
        first = left[symbol]
        symbol, place = np.concatenate([first, right[symbol]]), np.concatenate([place, place + np.where(first >= 0, lengths[np.maximum(first, 0)], 1)])
    return np.concatenate([*rules, np.zeros(0, np.int64)]), np.concatenate([*places, np.zeros(0, np.int64)])


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of texts whose words lie behind one another, by start, then period."""
    starts, stops = repeated_stretches(words, sizes)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    spans = stops - starts
    moved = np.cumsum(spans) - spans  # the stretches behind one another, and how far each was moved
    words, back_by = words[np.repeat(starts - moved, spans) + np.arange(int(spans.sum()))], starts - moved
    starts, stops = moved, moved + spans
    left, right, lengths, tops = grammars(words, starts, stops)
    rule, place = derived(left, right, lengths, tops)
    if not len(rule):
        return none, none, none
    used, first, back = np.unique(rule, return_index=True, return_inverse=True)
    here = place[first]
    first_size = np.where(left[used] >= 0, lengths[np.maximum(left[used], 0)], 1)
    node, a, b, q = boundary_runs(Blocks(words, int(lengths[used].max())), here, here + first_size, here + lengths[used])
    counts = np.bincount(node, minlength=len(used))
    offsets = np.cumsum(counts) - counts
    times = counts[back]
    row = np.repeat(offsets[back] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    shift = np.repeat(place, times) - here[node[row]]
    start, end, period = a[row] + shift, b[row] + shift, q[row]
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = np.append(-1, np.maximum.accumulate(period * (len(words) + 1) + end))[:-1]  # the furthest end so far of this period
    whole = period * (len(words) + 1) + end > reach
    start, end, period = start[whole], end[whole], period[whole]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    by = back_by[np.searchsorted(stops, start, "right")]
    return start + by, end + by, period


def repeat_tail(n: int, salt: int) -> np.ndarray:
    """Which original word stands at each place: from ``salt % n`` on, a part of the text over and over."""
    a = salt % n
    p = 1 + (n - a) // (3 + salt % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def text_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """Appends ``runs``, all runs of each text as structs (start, length, period), and ``collapsed``, the text without repeats.

    A word is left out of ``collapsed`` if a run holds it after that run's first
    period; the others are joined by one space. With ``plant`` the texts whose
    crc32 of the id divides by ten get a repeated tail first, so that every table
    holds long runs; a null id never does.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)])
    id_at, text_at = kept.index(doc_id), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"k{text_at}"):
                texts = [(t or "").encode("utf-8").split() for t in part.column(text_at).to_pylist()]
                if plant:
                    for i, d in enumerate(part.column(id_at).to_pylist()):
                        salt = 1 if d is None else zlib.crc32(str(d).encode())
                        if salt % 10 == 0 and texts[i]:
                            texts[i] = [texts[i][j] for j in repeat_tail(len(texts[i]), salt // 10).tolist()]
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                flat = [w for t in texts for w in t]
                numbers = {w: i for i, w in enumerate(dict.fromkeys(flat))}
                words = np.fromiter(map(numbers.__getitem__, flat), dtype=np.int64, count=len(flat))
                start, end, period = find_runs(words, sizes)
                begins = np.cumsum(sizes) - sizes
                owner = np.searchsorted(np.cumsum(sizes), start, "right")
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, end, -1)
                stays = np.cumsum(change[:-1]) == 0
                collapsed = []
                for t, a, whole in zip(texts, begins.tolist(), (np.bincount(owner, minlength=len(texts)) == 0).tolist(), strict=True):
                    own = t if whole else [w for w, s in zip(t, stays[a : a + len(t)].tolist(), strict=True) if s]
                    collapsed.append(b" ".join(own).decode("utf-8"))
                fields = [pa.array(x, pa.int64()) for x in (start - begins[owner], end - start, period)]
                structs = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), pa.array(collapsed, pa.string())], names=[*part.schema.names, "runs", "collapsed"])

    schema = ", ".join(f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(kept)))
    done = source.mapInArrow(run, f"{schema}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "runs", "collapsed")


def run_summary(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per row the number of runs, the longest one (smallest start, then period), and digests of all runs and of ``collapsed``."""
    longest = "element_at(array_sort(transform(runs, r -> struct(-r.length as size, r.start as start, r.period as period))), 1)"
    told = found.select(
        F.col(f"`{doc_id}`"),
        F.size("runs").cast("long").alias("n_runs"),
        F.expr(f"if(size(runs) > 0, {longest}, null)").alias("best"),
        F.sha2(F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    length = -F.col("best.size")
    milli = F.floor(1000 * length / F.col("best.period")).cast("long")
    return told.select(f"`{doc_id}`", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
