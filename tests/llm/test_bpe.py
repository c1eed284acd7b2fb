"""Byte-level BPE against tiktoken."""

from __future__ import annotations

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from latticework.llm import bpe
from latticework.llm.memo import Memo

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library() -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


ENCODER = bpe.Encoder(PATH, public_tokenizers.PATTERN)
ALPHABET = st.sampled_from(list("ab cdeE'strvmldé\n\t\r\x0b\x1c\x85 　²½Ⅷ一٣_.,!-=<|>\U0001f600́İß0123"))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(library: tiktoken.Encoding, text: str) -> None:
    assert ENCODER.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 4000, "-" * 4001, "é" * 3000, " " * 5000, "ab" * 3000, "<|endoftext|>" * 50, "'s't're" * 500])
def test_long_pieces(library: tiktoken.Encoding, text: str) -> None:
    assert ENCODER.encode(text) == library.encode_ordinary(text)


def test_a_very_long_piece_is_not_quadratic() -> None:
    assert len(ENCODER.encode("x" * 300_000)) > 0


def test_memo_keeps_what_is_used() -> None:
    memo = Memo(generation=3)
    for key in "abcd":
        memo.put(key, key.upper())
    assert memo.young == {"d": "D"} and memo.old("a") == "A" and memo.old("x") is None
    assert memo.put("k" * 1000, 1) == 1 and "k" * 1000 not in memo.young


def test_rows(spark: SparkSession, library: tiktoken.Encoding) -> None:
    texts = ["hello world", None, "", "hello world", "ñandú 日本語\n\n  x", "y " * 200_000]
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert [r["ids"] for r in back] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(r["decoded"]).decode() for r in back] == [t or "" for t in texts]
    named = spark.createDataFrame([("x", "hello world", "y")], ["a.b", "text", "q`r"])
    both = bpe.decode(bpe.encode(named, PATH, public_tokenizers.PATTERN), PATH)
    assert both.columns == ["a.b", "text", "q`r", "ids", "decoded"] and bytes(both.first()[4]) == b"hello world"
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
