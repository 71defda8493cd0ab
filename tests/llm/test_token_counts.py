import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noonward.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello  world\n\n it's", "<|endoftext|> a <|endoftext|>", "a<|endoftext|>b", "日本語" * 9, "x" * 3_000, "\u00a0 \x1c é", " " * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_as_the_library(library):
    want = [len(library.encode(t, add_special_tokens=False)) for t in TEXTS]
    assert tc.count_tokens(TEXTS, PATH, public_tokenizers.PATTERN).tolist() == want


def test_odd_rows_and_reuse(odd, library, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    rows = tc.token_counts(odd, PATH, public_tokenizers.PATTERN, cache).collect()
    assert len(rows) == 12
    for r in rows:
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False)))
    spark = odd.sparkSession
    stored = spark.read.parquet(cache)
    distinct = len({r.text or "" for r in rows})
    assert stored.count() == stored.select("digest").distinct().count() == distinct
    assert tc.encode_misses(odd, stored, PATH, public_tokenizers.PATTERN).count() == 0
    again = tc.token_counts(odd, PATH, public_tokenizers.PATTERN, cache).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert spark.read.parquet(cache).count() == distinct


def test_only_misses_are_encoded(documents, tmp_path):
    cache = str(tmp_path / "cache")
    tc.token_counts(documents([(1, "a b")]), PATH, public_tokenizers.PATTERN, cache).count()
    stored = tc.read_cache(documents([]).sparkSession, cache)
    docs = documents([(1, "a b"), (2, "c d"), (3, "c d")])
    assert tc.encode_misses(docs, stored, PATH, public_tokenizers.PATTERN).count() == 1


def test_counts_of_another_version_are_not_used(documents, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    docs = documents([(1, "a b")])
    tc.token_counts(docs, PATH, public_tokenizers.PATTERN, cache).count()
    monkeypatch.setattr(tc, "tokenizer_version", lambda path: "other")
    tc.token_counts(docs, PATH, public_tokenizers.PATTERN, cache).count()
    assert docs.sparkSession.read.parquet(cache).count() == 2


def test_empty_table_and_clashing_names(documents, clashing, tmp_path):
    empty = tc.token_counts(documents([]), PATH, public_tokenizers.PATTERN, str(tmp_path / "a"))
    assert empty.count() == 0
    df = tc.token_counts(clashing([(1, "a b")], "n_tokens", "N_BYTES", "digest"), PATH, public_tokenizers.PATTERN, str(tmp_path / "b"))
    assert df.first().asDict() | {"lang": 0} == dict(
        doc_id=1, text="a b", lang=0, source="src", n_chars=3, digest="mine", n_bytes=3, n_tokens=2
    )
