"""Token ids against two other implementations of the tokenizer, on texts of all kinds."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import bpe

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def other():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.default_path())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="ab =\n", max_size=400))
def test_any_text(encoder, other, text):
    assert encoder.encode(text) == other.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=120))
def test_ascii_texts_are_split_alike(encoder, other, text):
    assert encoder.split_ascii(text) == encoder.split(text)
    assert encoder.encode(text) == other.encode_ordinary(text)
    assert encoder.encode(text + "é") == other.encode_ordinary(text + "é")


def test_ascii_pattern():
    assert bpe.ascii_pattern(r" ?\p{L}+|[^\s\p{L}\p{N}]") == r" ?[A-Za-z]+|[^\sA-Za-z0-9]"
    assert bpe.ascii_pattern(r"\p{Lu}") is None


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 10_000, "=" * 5000, " " * 3000 + "x", "é" * 4000, "<|endoftext|>", "x<|endoftext|>\n", "ไม่มี 👩🏽‍🔧 ​"])
def test_long_and_odd_texts(encoder, other, text):
    assert encoder.encode(text) == other.encode_ordinary(text)


def test_json_vocabulary_agrees(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("Hello  world's\n\n\tif x==1:", "naïve <|endoftext|> 12345 über"):
        assert encoder.encode(text) == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, bpe.LARGEST - 1)), max_size=200))
def test_bitmap_finds_the_smallest(steps):
    bitmap, members = bpe.RankBitmap(), set()
    for add, x in steps:
        if add:
            bitmap.add(x)
            members.add(x)
        elif x in members:
            bitmap.discard(x)
            members.discard(x)
        assert bitmap.first() == min(members, default=-1)


def test_table_of_kept_tokens_is_bounded(encoder, other, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    text = " ".join(f"word{i}" for i in range(50))
    assert encoder.encode(text) == other.encode_ordinary(text) and len(encoder.kept) <= 5


def test_corpus(spark, other):
    texts = [None, "", "a", "a", " \n", "hello world"]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, ids int, source string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_corpus(df).collect()}
    assert got == {i: other.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert bpe.encode_corpus(df, carry=["source"]).columns == ["doc_id", "ids", "source"]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
