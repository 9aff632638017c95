"""Byte-level BPE against the library, over crafted, generated and given texts."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptgauge.llm import byte_bpe, queries
from scriptgauge.llm.common import table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.Ranks.load(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS.by_bytes, special_tokens={})


def encoded(text):
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    return encoder.ids([encoder.numbers(text)]).to_pylist()[0]


def round_trip(spark, rows, schema="doc_id long, text string, ids string, k0 int"):
    frame = byte_bpe.encode(spark.createDataFrame(rows, schema), PATH, public_tokenizers.PATTERN)
    return byte_bpe.decode(frame, PATH).collect()


def test_crafted_texts(spark):
    random.seed(5)
    texts = ["", " ", "  a", "a  b \n\n c", "<|endoftext|>", "don't I'll", "é😀ﬁ\n\t日本語のテキスト", "=" * 3000, "ab" * 900, " " * 700 + "x", "a\x00b", "१२३ ²½ Ⅷ", None]
    texts += ["".join(random.choice("ethaion s.'") for _ in range(random.randrange(900))) for _ in range(60)]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(0, texts[5], None, 1), (None, "null id", None, None)]
    found = round_trip(spark, rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded).decode(), str(r.k0)) for r in found) == sorted((str(i), LIBRARY.encode_ordinary(t or ""), t or "", str(k)) for i, t, _, k in rows)


def test_empty_table_and_null_ids(spark):
    assert round_trip(spark, []) == []
    frame = spark.createDataFrame([(1, None), (2, [31373]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode(frame, PATH).collect()} == {1: None, 2: RANKS.tokens[31373], 3: b""}


def test_very_long_text(spark):
    text = "".join(random.Random(3).choice("abcdefgh  ,\n") for _ in range(1_500_000))
    (row,) = round_trip(spark, [(1, text, None, None)])
    assert row.ids == LIBRARY.encode_ordinary(text) and bytes(row.decoded).decode() == text


@pytest.mark.parametrize("word", ["a" * 5001, "abc" * 3000, "".join(random.Random(1).choice("abc") for _ in range(4000))])
def test_one_long_pre_token(word):
    assert encoded(word) == LIBRARY.encode_ordinary(word)


def test_merges_of_an_earlier_rank():
    """A merge here makes a pair of an earlier rank next to a later place: order decides, and is the library's."""
    by_bytes = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abcd": 257, b"abc": 258, b"da": 259, b"cd": 260}
    pairs = sorted((by_bytes[t[:c]] << 32 | by_bytes[t[c:]], r) for t, r in by_bytes.items() for c in range(1, len(t)) if t[:c] in by_bytes and t[c:] in by_bytes)
    keys, ranks = (byte_bpe.np.array(x) for x in zip(*pairs, strict=True))
    tokens = [b""] * 261
    for t, r in by_bytes.items():
        tokens[r] = t
    made = byte_bpe.Ranks(tokens, by_bytes, byte_bpe.np.arange(256, dtype="int32"), keys.astype("int64"), ranks.astype("int32"))
    words = ["".join(random.Random(i).choice("abcd") for _ in range(i % 23)).encode() for i in range(400)]
    flat, sizes = byte_bpe.replay(made, words)
    library = tiktoken.Encoding("small", pat_str=r"[a-z]+", mergeable_ranks=by_bytes, special_tokens={})
    assert [x.tolist() for x in byte_bpe.np.split(flat, byte_bpe.np.cumsum(sizes)[:-1])] == [library.encode_ordinary(w.decode()) for w in words]


def test_query_over_given_texts(spark, small):
    texts = {r.doc_id: r.text or "" for r in table(spark, small, "documents").collect()}
    want = {}
    for k, t in texts.items():
        ids = LIBRARY.encode_ordinary(t)
        want[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    rows = queries.op11_byte_bpe_round_trip(spark, small).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert encoded(text) == LIBRARY.encode_ordinary(text)
    for word in byte_bpe.regex.findall(public_tokenizers.PATTERN, text):
        assert [LIBRARY.encode_ordinary(word)] == [[RANKS.by_bytes[w]] if (w := word.encode()) in RANKS.by_bytes else byte_bpe.encode_alone(RANKS, w)]
