"""Every stage of the pipeline against what its operator promises, and the whole against its stages."""

from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
import sentencepiece

from scriptgauge.llm import lines, mixing, simhash
from scriptgauge.llm.common import settled, table


@pytest.fixture(scope="module")
def steps(spark, small):
    """Documents before the first and after each stage."""
    docs, out = table(spark, small, "documents"), []
    for name, stage in pipeline.STAGES:
        out.append(docs)
        docs = settled(stage(spark, docs, small), name)
    return [*out, docs]


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_order_and_columns(steps):
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "near-duplicates", "mix", "pieces"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_keeps_clean_documents(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert set(after) <= set(before) and len(after) > 0.97 * len(before)
    assert all(after[i] == before[i] for i in after)


def test_lines_that_stay_are_first_of_their_class(steps):
    kept = {(r.doc_id, r.line_no): r.kept for r in lines.line_classes(steps[1]).collect()}
    after = rows(steps[2])
    for i, r in rows(steps[1]).items():
        left = [x for n, x in enumerate(r.text.split("\n")) if kept.get((i, n), True)]
        assert (i in after) == any(map(lines.VISIBLE.search, left))
        if i in after:
            assert after[i].text == "\n".join(left) and after[i].n_chars == len(after[i].text)


def test_one_of_each_group_stays(steps):
    before, after = rows(steps[2]), rows(steps[3])
    marks = {i: simhash.fingerprint(r.text) for i, r in before.items()}
    at = {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for a in marks:
            for b in marks:
                if (marks[a] ^ marks[b]).bit_count() <= 3 and at[a] < at[b]:
                    at[b], changed = at[a], True
    assert set(after) == set(at.values()) and steps[3].count() == len(after)


def test_mix_repeats_whole_documents(steps):
    before, copies = rows(steps[3]), Counter(r.doc_id for r in steps[4].collect())
    plan = {r.doc_id: r.copies for r in mixing.copies(steps[3]).collect()}
    assert {i: n for i, n in plan.items() if n} == dict(copies)
    assert all(r == before[r.doc_id] for r in steps[4].collect())


def test_pieces_are_the_librarys(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.PIECES))
    wanted = Counter((r.doc_id, tuple(library.encode(r.text))) for r in steps[4].collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in steps[5].collect()) == wanted


def test_odd_documents_pass_through(spark, small, steps):
    odd = [(1, None, None, None, 0, "x"), (1, "", "en", "s", 0, "x"), (None, "the cat sat on the mat and the dog", "en", None, 3, "x"), (7, "the dog sat on the mat with the cat", "en", "s", 1, "x"), (7, "the dog sat on the mat with the cat", "en", "s", 1, "x")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for given in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            columns, given = given.columns, settled(stage(spark, given, small), name)
            assert name == "pieces" or given.columns == columns
    assert given.count() == 0


def test_groups_without_an_id_of_their_own_keep_a_document(spark, small):
    texts = ["the cat sat on the mat and the dog", "one ship sailed far over the cold sea", "rain fell on the green hills all day", "he paid for bread and went home late", "she reads long books about old kings"]
    given = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[3]), (3, texts[4]), (None, texts[4]), (4, texts[3])]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    left = pipeline.drop_near_duplicates(spark, docs, small).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[3]), (3, texts[4])], key=str)
