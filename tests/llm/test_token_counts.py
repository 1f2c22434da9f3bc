from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from bulwark.llm import token_counts as tc
from bulwark.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return tc.TokenCounter(PATH, tc.whole_tokens(PATH))


def many(lib, text):
    return len(lib.encode(text or "", add_special_tokens=False).ids)


ODD = [
    "", " ", "\n", "   a", "a   ", "it's we'll I'M don't", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "a" * 900, "\x1c \x1f\x85 x\xa0y",
    "漢字かな交じり文 と text", "😀😀 ok", "é́ x", "²³½ 12 1²", "   wide　 ", "\t\t\nx", "ʯʰ mixed", "€5 – “q”…", "a\x00b\x7f",
]


def test_equals_the_library(lib, own):
    rng = random.Random(3)
    letters = "aeiou tsnhr  \n\t'sl12.!?<|>€–éßÉ²　\xa0漢é"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 60))) for _ in range(300)]
    assert [own.count(t) for t in texts] == [many(lib, t) for t in texts]


def test_written_classes_agree_with_the_splitter(lib, own):
    """Every character of the Latin range, in five surroundings, splits as the vocabulary's own splitter does."""
    for c in map(chr, [*range(0x2B0), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)]):
        text = f"a{c}b {c} 1{c}2{c}{c}. {c}x{c}\n{c}"
        assert tc.LATIN.fullmatch(text)
        assert tc.PRE_TOKEN.findall(text) == [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_whole_tokens_are_proven(lib):
    whole = tc.whole_tokens(PATH)
    assert len(whole) > 49_000 and len(set(whole)) == len(whole)
    lone = [t for t in whole if len(lib.pre_tokenizer.pre_tokenize_str(t)) == 1]  # the others never are a pre-token
    assert len(lone) > 45_000
    assert all(len(e.ids) == 1 for e in lib.encode_batch(lone, add_special_tokens=False))


def test_pieces_and_memory_change_nothing(lib, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["word", "wörd's", " ", "  ", "\n\n ", "123", "漢字", "<|endoftext|>", "\xa0", "\u3000", "\u1680"]) for _ in range(4000))
    monkeypatch.setattr(tc, "PIECE", 7)
    monkeypatch.setattr(tc.pieces, "__defaults__", (7,))
    monkeypatch.setattr(tc, "CACHE", 3)
    assert "".join(tc.pieces(text)) == text and len([*tc.pieces(text)]) > 500
    assert tc.TokenCounter(PATH, tc.whole_tokens(PATH)).count(text) == many(lib, text)


def test_long_words_and_texts(lib, own):
    for text in ("ab" * 200_000, "x" * 300_000, " " * 100_000, "word " * 400_000):
        assert own.count(text) == many(lib, text)


def test_documents(docs, edge_rows, lib):
    got = sorted(map(tuple, tc.token_counts(docs(edge_rows)).collect()), key=str)
    want = [(i, len((t or "").encode()), n := many(lib, t), n > 1024) for i, t, _, _ in edge_rows]
    assert got == sorted(want, key=str)
    assert any(w[3] for w in want)
    empty = tc.token_counts(docs([]))
    assert empty.count() == 0 and [t for _, t in empty.dtypes] == ["bigint", "bigint", "bigint", "boolean"]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tc.Merges(tokenizer_path("word_bpe_49k.json"))
