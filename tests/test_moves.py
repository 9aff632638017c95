"""Renamed and moved units: planted moves, copies, and candidate pairs against brute force."""

import random

from pyspark.sql import functions as F

from scriptgauge.operators import moves, units
from scriptgauge.plans import catalog
from scriptgauge.sources import corpus

SCHEMA = "unit_id string, path string, unit_name string, source_code string"


def body(rng, n=60):
    return " ".join(rng.choice(["select", "from", "where", "and", ";", "x", "y", "("]) + f" v{rng.randrange(400)}" for _ in range(n))


def run(spark, old, new, **options):
    rows = moves.version_moves(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), **options).collect()
    assert len({r.old_unit_id for r in rows}) == len({r.new_unit_id for r in rows}) == len(rows)
    return {r.old_unit_id: r.new_unit_id for r in rows}


def test_planted_moves_in_a_corpus_whose_texts_change_too(spark, small):
    """Every tenth order's text is another one in the new version; moved and renamed units are found among all others."""
    old = units.split_units(corpus.derive(spark, small, corpus.CORPUS_PROCEDURES))
    changed = corpus.derive(spark, small, corpus.CORPUS_PROCEDURES_V2)
    renamed = changed.withColumn("src", F.expr(corpus.RENAMED.format("src"))).withColumn("script_id", F.expr(corpus.MOVED_SCRIPT))
    found = moves.version_moves(old, units.split_units(renamed)).collect()
    before, after = ({r.unit_id: r.unit_kind for r in x.select("unit_id", "unit_kind").collect()} for x in (old, units.split_units(renamed)))
    planted = {}
    for unit in before.keys() - after.keys():
        script, name = unit.split(":", 1)
        number = int(script[1:])
        name = name.replace(f"proc_{number}", f"task_{number}") if number % 11 == 2 and before[unit] != "SCRIPT" else name
        planted[unit] = f"{'moved_' if number % 17 == 3 else ''}{script}:{name}"
    assert len(planted) > 100 and set(planted.values()) <= after.keys() - before.keys()
    right = sum(planted.get(r.old_unit_id) == r.new_unit_id for r in found)
    assert right >= 0.9 * len(planted) and right >= 0.9 * len(found)


def test_renamed_moved_edited_and_gone(spark):
    rng = random.Random(2)
    texts = [body(rng) for _ in range(8)]
    old = [(f"a:{i}", "in/a.sql", f"p{i}", f"PROCEDURE p{i} IS {t} p{i}(x)") for i, t in enumerate(texts)]
    old += [("b:gone", "in/b.sql", "gone", body(rng)), ("b:stays", "in/b.sql", "stays", texts[0]), (None, None, None, None)]
    new = [(f"z:{i}", "out/z.sql", f"q{i}", f"PROCEDURE q{i} IS {t} q{i}(x)") for i, t in enumerate(texts)]
    new[3] = (*new[3][:3], new[3][3] + " AND one_more_line = 1")
    new += [("b:fresh", "in/b.sql", "fresh", body(rng)), ("b:stays", "in/b.sql", "stays", texts[1]), (None, "x", "y", "z")]
    assert run(spark, old, new) == {f"a:{i}": f"z:{i}" for i in range(8)}


def test_copies_pair_by_file_then_by_number(spark):
    rng = random.Random(4)
    text = body(rng)
    old = [(f"a{i}:p", f"in/f{i}.sql", "p", text) for i in range(300)] + [("e:1", None, None, None), ("e:2", "in/e.sql", "e", "")]
    new = [(f"b{i}:p", f"other/f{i}.sql", "p", text) for i in range(200)] + [(f"c{i}:p", f"other/g{i}.sql", "p", text) for i in range(60)] + [("n:1", "in/e.sql", "e", " ")]
    found = run(spark, old, new)
    assert all(found[f"a{i}:p"] == f"b{i}:p" for i in range(200))
    assert {v for k, v in found.items() if k[0] == "a"} >= {f"c{i}:p" for i in range(60)} and len(found) == 261
    assert found["e:2"] == "n:1"


def test_candidate_pairs_against_brute_force(spark):
    rng = random.Random(8)
    bases = [body(rng, 25).split() for _ in range(6)]

    def variant():
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
        return " ".join(words)

    frames = [moves.fingerprints(spark.createDataFrame([(f"{s}{i}", "f.sql", "none", variant()) for i in range(60)], SCHEMA)) for s in "on"]
    sets = [{r["class"]: set(r.prints) for r in f.collect()} for f in frames]
    want = {(x, y) for x, a in sets[0].items() for y, b in sets[1].items() if len(a & b) >= 0.6 * len(a | b)}
    got = [(r.x, r.y) for r in moves.class_pairs(*frames).collect()]
    assert len(want) > 30 and sorted(got) == sorted(want)


def test_no_units(spark):
    assert run(spark, [], []) == {} and run(spark, [("a:1", "f", "n", "x")], []) == {}


def test_registered_query_finds_packages_too(spark, small):
    rows = catalog.QUERIES["version_moves"](spark, small).collect()
    assert any(r.old_unit_id.startswith("c") and ":q_" in r.new_unit_id for r in rows) and any(r.new_unit_id.startswith("moved_") for r in rows)
