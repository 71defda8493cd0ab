import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from noonward.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    flat, per_text = bpe.encode_texts(texts, bpe.ranks_at(PATH), public_tokenizers.PATTERN)
    return [part.tolist() for part in np.split(flat, np.cumsum(per_text)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), min_size=1, max_size=5))
def test_as_the_library(library, texts):
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize(
    "text",
    ["", "a", " " * 3_000, "ab" * 2_000, "The quick brown fox's 1234 hats", "日本語のテキスト" * 300, "<|endoftext|>", "é" * 1_500 + " x"],
)
def test_long_and_odd_matches(library, text):
    assert encoded([text]) == [library.encode_ordinary(text)]


def test_heap_and_matrix_agree(monkeypatch):
    texts = ["understanding", "antidisestablishmentarianism", "xyzzyxyzzy" * 20]
    by_matrix = encoded(texts)
    monkeypatch.setattr(bpe, "MATRIX_BYTES", 0)
    assert encoded(texts) == by_matrix


def test_table_holds_every_pair():
    ranks = bpe.ranks_at(PATH)
    some = [t for t in list(ranks.by_bytes)[300:600] if len(t) > 1]
    for token in some:
        cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
        pairs = [(ranks.by_bytes[a], ranks.by_bytes[b]) for a, b in cuts if a in ranks.by_bytes and b in ranks.by_bytes]
        left, right = (np.array(x, np.int32) for x in zip(*pairs))
        assert set(ranks.pair_ranks(left, right).tolist()) == {ranks.by_bytes[token]}
    assert ranks.pair_ranks(np.array([-1], np.int32), np.array([3], np.int32))[0] == bpe.NO_PAIR


def test_round_trip_of_odd_rows(odd):
    apart = bpe.decode(bpe.encode(odd, PATH, public_tokenizers.PATTERN), PATH)
    at_once = bpe.encode_and_decode(odd, PATH, public_tokenizers.PATTERN)
    for df in (apart, at_once):
        rows = df.collect()
        assert len(rows) == 12
        for r in rows:
            assert bytes(r.decoded) == (r.text or "").encode()
            assert (r.ids == []) == (not r.text)
    assert sorted(map(str, apart.collect())) == sorted(map(str, at_once.collect()))


def test_empty_table_and_clashing_names(documents, clashing):
    assert bpe.encode_and_decode(documents([]), PATH, public_tokenizers.PATTERN).count() == 0
    df = bpe.encode_and_decode(clashing([(1, "hello")], "ids", "DECODED"), PATH, public_tokenizers.PATTERN)
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    assert bytes(df.first().decoded) == b"hello"


def test_missing_ids_give_no_bytes(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(df, PATH).collect()] == [b"", b""]
