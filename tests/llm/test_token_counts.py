"""Token counts against the library, over crafted and given texts."""

import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptgauge.llm import queries, token_counts
from scriptgauge.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def counted(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, rank int")
    return sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(frame, PATH).collect()), key=str)


def test_crafted_texts(spark, library):
    random.seed(4)
    texts = ["", " ", "  a", "a  b    c", "<s>x</s>▁y", "é😀ﬁ\n\n\t日本語のテキスト", "=" * 3000, "ab" * 900, " " * 700 + "x", "<0x0A>", "a\x00b", None]
    texts += ["".join(random.choice("ethaion s.") for _ in range(random.randrange(900))) for _ in range(60)]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(0, texts[5], None, 1), (None, "null id", None, None)]
    assert counted(spark, rows) == sorted(((i, len(library.encode(t or ""))) for i, t, *_ in rows), key=str)


def test_empty_table(spark):
    assert counted(spark, []) == []


def test_query_over_given_texts(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, small, "documents").collect()}
    rows = queries.op8_token_counts(spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {k: (len(t.encode()), n := len(library.encode(t)), n > 4096) for k, t in texts.items()}


TABLE = token_counts.PieceTable.load(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab t▁éh\n01eon", max_size=60))
def test_any_text(text):
    parts = token_counts.SEGMENT.findall("▁" + text.replace(" ", "▁")) if text else []
    assert sum(token_counts.survivors(TABLE, parts)) == len(LIBRARY.encode(text))
    assert all(len(token_counts.merge_long(TABLE, TABLE.start(p))) == len(token_counts.merge_all(TABLE, [p])[0]) for p in parts)
