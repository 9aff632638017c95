"""The edit-distance join against all pairs, and what is left of documents."""

import random
import time

import numpy as np
import xxhash

from scriptgauge.llm import lines, queries


def distance(a, b):
    if min(len(a), len(b)) > 5000 and (a.startswith(b) or b.startswith(a)):
        return abs(len(a) - len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def linked(a, b):
    return a != b and (k := lines.edits_allowed(min(len(a), len(b)))) > 0 and abs(len(a) - len(b)) <= k and distance(a, b) <= k


def edited(text, edits, rng):
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        text = text[:at] + rng.choice(["", "x", "é"]) + text[at + rng.randrange(2) :]
    return text


def test_banded_distance_is_exact():
    rng = random.Random(1)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 30)))
        pairs.append((a, edited(a, rng.randrange(6), rng)))
    pairs += [("", ""), ("", "ab"), ("a" * 500, "a" * 498), ("ab" * 300, "ba" * 300), ("x" + "ab" * 300, "ab" * 300 + "x")]
    for k in (1, 2, 3, 5):
        got = lines.within([a for a, _ in pairs], [b for _, b in pairs], np.full(len(pairs), k))
        assert got.tolist() == [distance(a, b) <= k for a, b in pairs]


def test_parities_turn_four_bits_an_edit():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 90))) for _ in range(400)]
    for edits in (1, 2):
        near = [edited(x, edits, rng) for x in base]
        turned = np.bitwise_count(lines.pair_parity(base).view(np.uint64) ^ lines.pair_parity(near).view(np.uint64))
        assert turned.max() <= 4 * edits and len(lines.pair_parity([])) == 0


def test_outlines_keep_every_link_and_tell_inserted_words_apart(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(90))
    lines_of = [base[:at] + "".join(rng.choice("qrstuvwxyzabcdef") for _ in range(4)) + base[at:] for at in (rng.randrange(90) for _ in range(50))]
    lines_of += [edited(rng.choice(lines_of), rng.choice([1, 2]), rng) for _ in range(30)] + ["", "é" * 25, "é" * 24 + "x", "short line of text 1"]
    for size, words in lines.PARITY_WORDS.items():
        for edits in (1, 2):
            near = [edited(x, edits, rng) for x in lines_of]
            turned = np.bitwise_count(lines.gram_parity(lines_of, size, words).view(np.uint64) ^ lines.gram_parity(near, size, words).view(np.uint64)).sum(axis=0)
            assert turned.max() <= 2 * size * edits
    # a line's parities do not depend on the lines beside it
    assert lines.outlines(lines_of).to_pylist()[7:9] == lines.outlines(lines_of[7:9]).to_pylist() and len(lines.outlines([])) == 0
    rows = [{"i": i, "bits": o} for i, o in enumerate(lines.outlines(lines_of).to_pylist())]
    frame = spark.createDataFrame(rows, f"i int, bits {lines.OUTLINE}")
    sides = [frame.selectExpr(f"i as {x}", f"bits as bits_{x}") for x in ("x", "y")]
    kept = {(r.x, r.y) for r in sides[0].crossJoin(sides[1]).where(f"x < y and {lines.may_link()}").select("x", "y").collect()}
    real = {(i, j) for i, a in enumerate(lines_of) for j, b in enumerate(lines_of) if i < j and a != b and linked(a, b)}
    assert len(real) > 10 and real <= kept
    inserted = {(i, j) for i, j in kept if j < 50}
    assert len(inserted - real) < 0.02 * 50 * 49 / 2


def by_brute_force(docs):
    spots = sorted((lines.LAST if i is None else i, n, x) for i, t in docs for n, x in enumerate((t or "").split("\n")) if lines.VISIBLE.search(x))
    texts = sorted({x for *_, x in spots})
    near = {x: [y for y in texts if linked(x, y)] for x in texts}
    first = {}
    for i, n, x in spots:
        if x not in first:
            todo, first[x] = [x], (i, n)
            while todo:
                for y in near[todo.pop()]:
                    if y not in first:
                        first[y] = (i, n)
                        todo.append(y)
    return {(i, n): (*first[x], first[x] == (i, n)) for i, n, x in spots}


def corpus():
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 19, 20, 25, 39, 40, 41, 80, 120]))) for _ in range(25)]
    docs = [(i, "\n".join(edited(rng.choice(base), rng.choice([0, 0, 1, 2, 3]), rng) for _ in range(rng.randrange(1, 8)))) for i in range(40)]
    return docs + [(100, None), (101, ""), (102, " \n\t\n"), (103, "z" * 6_000), (104, "z" * 6_001 + "\n" + base[8]), (None, base[7] + "\nonly here")]


def test_classes_against_all_pairs(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, key string")
    rows = lines.line_classes(frame).collect()
    got = {(lines.LAST if r.doc_id is None else r.doc_id, r.line_no): (lines.LAST if r.class_doc_id is None else r.class_doc_id, r.class_line_no, r.kept) for r in rows}
    expected = by_brute_force(docs)
    assert got == expected and len(rows) == len(expected)
    assert sum(not v[2] for v in got.values()) > 25
    left = {r.doc_id: r.text for r in lines.without_repeated_lines(frame).collect()}
    for i, t in docs:
        at = lines.LAST if i is None else i
        kept = [x for n, x in enumerate((t or "").split("\n")) if expected.get((at, n), (0, 0, True))[2]]
        whole = len(kept) == len((t or "").split("\n"))
        assert left.get(i, "gone") == (t if whole else "\n".join(kept) if any(map(lines.VISIBLE.search, kept)) else "gone")
    assert lines.without_repeated_lines(frame).columns == frame.columns


def test_large_candidate_sets_join_by_shuffle(spark, monkeypatch):
    frame = spark.createDataFrame(corpus()[:15], "doc_id long, text string")
    small = sorted(map(tuple, lines.line_classes(frame).collect()), key=str)
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert sorted(map(tuple, lines.line_classes(frame).collect()), key=str) == small


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "one line that is long enough"), (1, "one line that is long enough"), (2, "one line that is long enough!")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in lines.line_classes(frame).collect()) == [(1, True), (1, True), (2, False)]
    assert lines.line_classes(frame.limit(0)).collect() == [] and lines.without_repeated_lines(frame.limit(0)).collect() == []


def test_query_over_given_texts(spark, small):
    out = queries.op4_line_dedup(spark, small)
    assert out.columns == ["doc_id", "line_no", "class_doc_id", "class_line_no", "kept"]
    assert out.where("kept != (doc_id = class_doc_id and line_no = class_line_no)").count() == 0 and out.where("not kept").count() > 0


def test_signatures_of_equal_substrings_are_equal(spark, monkeypatch):
    """A substring has one signature wherever it stands, also in lines of another chunk and in lines about as long as a chunk."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé𝄞 ") for _ in range(rng.randrange(20, 120))) for _ in range(200)]
    plain = lambda x, indexed: [(s * 8 + i, x[a : a + n]) for s, i, a, n in ([(len(x), i, a, n) for i, (a, n) in enumerate(lines.segments(len(x)))] if indexed else lines.probes(len(x)))]
    for most in (60, 61, 1000, 200_000):
        monkeypatch.setattr(lines, "CHUNK_CHARS", most)
        told = {}
        for indexed in (True, False):
            for chunk in lines.chunks(base):
                keys, sizes = lines.line_keys(chunk, indexed)
                parts = [p for x in chunk for p in plain(x, indexed)]
                assert sum(sizes) == len(parts) == len(keys)
                for part, key in zip(parts, keys.tolist(), strict=True):
                    assert told.setdefault(part, key) == key
        assert len(set(told.values())) == len(told)


def test_signatures_are_not_taken_one_by_one():
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(20_000)]
    took = []
    for _ in range(3):  # the first fills the caches
        start = time.process_time()
        found = sum(len(lines.line_keys(chunk, False)[0]) for chunk in lines.chunks(base))
        middle = time.process_time()
        single = [xxhash.xxh64_intdigest(x[a : a + n].encode("utf-8", "surrogatepass"), s * 8 + i) for x in base for s, i, a, n in lines.probes(len(x))]
        took.append((middle - start) / (time.process_time() - middle))
        assert found == len(single)
    assert min(took) < 0.8
