from __future__ import annotations

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from bulwark.llm import bpe
from bulwark.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ODD = [
    "", "a", "a" * 800, "Hello wörld's 12 <|endoftext|>x \x1c\x85\xa0b İSTANBUL ΑΣ é ́x </w> </w></w> 😀😀 漢字かな don't I'LL   \n\tx",
    "\x00\x01\x7f ​ ﬁ ²³ ½ ٣", "a\x0bb\x0cc", "llllos osllllas hehehe", "<|startoftext|><|endoftext|>", " wide　space",
]


def test_equals_the_library():
    lib, own = Tokenizer.from_file(PATH), bpe.word_bpe(PATH)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aeioutsnhr </w>'.!ABÉéßΣ9 1\n ") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        want = lib.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    own, lib = bpe.WordBpe(PATH), Tokenizer.from_file(PATH)
    text = " ".join(f"w{i % 7}" for i in range(40))
    for _ in range(3):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_documents(docs, edge_rows):
    lib = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, bpe.encode_digests(docs(edge_rows)).collect()), key=str)
    want = []
    for i, t, _, _ in edge_rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        said = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(docs([])).count() == 0
    row = bpe.encode_documents(docs([(1, "Hi there", "en", "s")])).first()
    assert row.n_tokens == 2 and row.decoded == "hi</w> there</w>"
