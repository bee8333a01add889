"""Token counts against the tokenizer itself."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

from telltale.llm import tokens
from telltale.llm.queries import QUERIES


@pytest.fixture(scope="module")
def known():
    return tokens.prove(public_tokenizers.path("piece_bpe_32k.model"))


def test_whole_table_against_the_library(spark, sf_dir, docs_rows, known):
    encoder = tokens.Counter(known).encoder
    rows = QUERIES["op13_token_counts"](spark, sf_dir).collect()
    expected = {i: len(encoder.encode(t or "")) for i, t, *_ in docs_rows}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == expected
    assert all(r["n_bytes"] == len((t or "").encode()) for r, (_, t, *_) in zip(sorted(rows, key=lambda r: r["doc_id"]), docs_rows, strict=True))
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows) and any(r["over_limit"] for r in rows)


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_odd_strings_in_slices_of_any_size(known, monkeypatch, size):
    monkeypatch.setattr(tokens, "SLICE", size)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    counter, draw = tokens.Counter(known), random.Random(size)
    bits = ["a", "b", " ", "  ", "\n", "▁", "▁▁", "　", "é", "the", "ing", "<s>", "</s>", "<unk>", "<0x0A>", "中", "\t", "\x00", "😀", "of", ",", " a"]
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(30)))
        assert counter.count(text) == len(counter.encoder.encode(text)), text
    assert len(counter) <= len(known.words) + 51


def test_proven_words_are_one_token_and_most_words_of_a_text_are_proven(spark, known):
    encoder = tokens.Counter(known).encoder
    assert len(known.words) > 15_000 and all(len(encoder.encode(w)) == 1 for w in known.words)
    docs = spark.createDataFrame([("the house is on the hill",), ("qqzzxx the",), (None,)], "text string")
    assert tuple(tokens.unknown_share(docs, known).first()) == (8, 7)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.prove(public_tokenizers.path("byte_bpe_50k.json"))


def test_odd_rows(spark, odd, nothing, known):
    rows = tokens.count_tokens(odd, known, limit=10).collect()
    encoder = tokens.Counter(known).encoder
    expected = sorted(((r["doc_id"] is None, r["doc_id"] or 0), len((r["text"] or "").encode()), len(encoder.encode(r["text"] or ""))) for r in odd.collect())
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 10) for r in rows)
    assert tokens.count_tokens(nothing, known).count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"ab \xff c"))], "doc_id long, text binary")
    assert [tuple(r) for r in tokens.count_tokens(broken, known).collect()] == [(1, 6, len(encoder.encode("ab � c")), False)]
