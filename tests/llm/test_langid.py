"""Sums over segmentations by enumeration, and accuracy on rows that were never learned from."""

import math

import numpy as np
import public_tokenizers

from scriptgauge.llm import langid, queries
from scriptgauge.llm.common import table

PIECES = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab"]


def segmentations(text, chance):
    if not text:
        return 1.0
    total = 0.0
    for n in range(1, len(text) + 1):
        head = text[:n]
        p = chance.get(head, langid.FLOOR if n == 1 else None)
        if p:
            total += p * segmentations(text[n:], chance)
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(3)
    chance = np.vstack([rng.random((len(PIECES), 2)), np.full((1, 2), langid.FLOOR)])
    words = ["", "a", "abc", "abcabc", "xaby", "c" * 9, "ab" * 6]
    got = langid.word_scores(words, langid.PieceIndex.of(PIECES), chance)
    for k in range(2):
        model = dict(zip(PIECES, chance[:, k], strict=False))
        assert np.allclose(got[:, k], [math.log(segmentations("▁" + w, model)) for w in words])
    lattice = langid.Lattice.of(words, langid.PieceIndex.of(PIECES))
    p = chance[lattice.piece]
    assert np.allclose(lattice.backward(p)[0], lattice.forward(p)[lattice.ends, np.arange(len(words))])


def test_held_out_accuracy_over_given_texts(spark, small):
    labels = {r.doc_id: r.lang for r in table(spark, small, "documents").collect()}
    rows = queries.op5_language_id(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(labels)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == labels[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    texts = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("die katze und der hund", None)] * 20
    docs = spark.createDataFrame([(i, t, g, 1) for i, (t, g) in enumerate(texts)], "doc_id long, text string, lang string, score int")
    model = langid.fit(docs, langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    assert model.languages == ["en", "fr"]
    odd = [(1, None), (2, ""), (3, "12 + 3 = _"), (4, "THE CAT"), (4, "THE CAT"), (None, "le chien"), (5, "日本" * 300), (6, "the dog " * 60_000)]
    frame = spark.createDataFrame([(i, t, None, "fr") for i, t in odd], "doc_id long, text string, score string, lang string")
    out = sorted(((r.doc_id, r.lang_pred) for r in langid.predict(frame, model).collect() if r.doc_id != 5), key=str)
    assert out == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "fr"), (6, "en")], key=str)
    none = langid.fit(docs.limit(0), ["a"])
    assert {(r.lang_pred, r.score) for r in langid.predict(frame, none).collect()} == {("und", 0.0)}
    assert langid.predict(frame.limit(0), model).collect() == []


def test_learning_takes_three_passes(spark):
    docs = spark.createDataFrame([("abc ab abc bc", "x"), ("ab ab a b c", "y")], "text string, lang string")
    given = langid.fit(docs, PIECES).chance
    assert np.array_equal(given, langid.fit(docs, PIECES, passes=3).chance)
    assert not np.allclose(given, langid.fit(docs, PIECES, passes=2).chance, rtol=1e-6)
