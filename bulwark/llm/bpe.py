"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, one merge gadget after another, into a deterministic automaton over
*tokens* that accepts exactly the token sequences BPE itself produces:

* it starts as one state with a loop for every base symbol;
* the gadget for a merge ``(u, v) -> w`` copies the state that ``u`` leads to, cuts the ``v`` arc out
  of the copy and lets ``u`` lead there; ``w`` gets an arc wherever ``u`` has one, and leads where
  ``v`` led at that moment.

All arcs of one token lead to one state, so a state is kept as a *track* (the cuts made for a token,
each with its merge number) plus the track and moment it was copied from.  An arc exists unless a
cut hits the arc's token or a left ancestor of it no later than the next one was born (the same moment
where a token merges with itself).

Encoding follows arcs over a pre-split word, the longest first.  A prefix of a word has one run at most, so a position
from which no arc leads on is given up for good, and a word takes time in proportion to its length.  Arcs
are looked up in a table that is filled on first use.  Decoding emits the arc labels, joined by one space as the
vocabulary has no decoder of its own.

Defined cases: null and empty texts give zero tokens, an empty decoding and the hashes of empty input; very long texts and words are
encoded whole; repeated rows are encoded alike; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from bulwark.llm.common import map_batches, text_bytes, tokenizer_path

#: Chunks remembered by one Python worker in each of two generations.
CACHE = 320_000
#: Arcs kept in the table before it is filled anew.
ARCS = 300_000
END = "</w>"
#: Added to the code point of a word's last symbol.
LAST = 0xE000
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")


def symbols(token: str) -> str:
    """A vocabulary entry with its word end folded into the last symbol."""
    return token[: -len(END) - 1] + chr(ord(token[-len(END) - 1]) + LAST) if token.endswith(END) and token != END else token


class MergeAutomaton:
    """The deterministic tokenization automaton of a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        n = max(vocab.values()) + 1
        self.ids = {symbols(t): i for t, i in vocab.items()}
        self.label = {i: t for t, i in vocab.items()}
        self.longest = max(map(len, self.ids))
        self.born = [-1] * n
        self.left = [-1] * n
        self.cuts: list[dict[int, int] | None] = [None] * n
        #: Where a token's track was copied from: the other token and the moment.
        self.source: list[tuple[int, int] | None] = [None] * n
        self.arcs: dict[int, bool] = {}
        for moment, (u, v) in enumerate(merges):
            self._gadget(moment, vocab[u], vocab[v], vocab[u + v])

    def _gadget(self, moment: int, u: int, v: int, w: int) -> None:
        self.born[w], self.left[w] = moment, u
        self.source[w] = (v, moment)  # v's state before u's is copied: they may be the same token
        if self.cuts[u] is None:
            self.cuts[u] = {}
        self.cuts[u].setdefault(v, moment)

    def arc(self, before: int, token: int) -> bool:
        """Whether the state that ``before`` leads to has an arc for ``token``."""
        key = before << 20 | token
        if (known := self.arcs.get(key)) is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._arc(before, token)
        return known

    def _arc(self, before: int, token: int) -> bool:
        until = len(self.label) + len(self.ids)
        while True:
            if cuts := self.cuts[before]:
                x, next_born = token, until
                while x >= 0:
                    cut = cuts.get(x)
                    if cut is not None and cut < until and cut <= next_born:
                        return False
                    next_born, x = self.born[x], self.left[x]
            if self.source[before] is None:
                return True
            before, until = self.source[before][0], min(until, self.source[before][1])

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word, given as symbols."""
        n, get, arcs, longest = len(word), self.ids.get, self.arcs, self.longest
        path: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, end, before = 0, min(n, longest), -1
        while at < n:
            while end > at:
                token = get(word[at:end])
                if token is not None and end not in dead:
                    if before < 0:
                        break
                    if (open_ := arcs.get(before << 20 | token)) is None:
                        open_ = self.arc(before, token)
                    if open_:
                        break
                end -= 1
            if end > at:
                path.append(token)
                starts.append(at)
                at, before = end, token
                end = min(n, at + longest)
            else:  # no run goes on from here
                dead.add(at)
                path.pop()
                end, at = at - 1, starts.pop()
                before = path[-1] if path else -1
        return path


class WordBpe:
    """Whole texts through the automaton, with the vocabulary file's own normalizer and splitter."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(spec["model"]["vocab"], merges)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.label = self.automaton.label | {i: t for t, i in self.special.items()}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _words(self, piece: str) -> list[str]:
        if piece.isascii():
            return ASCII_WORDS.findall(piece.lower())
        return [w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(piece))]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Tokens of a piece of text between ASCII white space, which no token ever crosses."""
        out: list[int] = []
        for piece in SPECIAL.split(chunk) if "<|" in chunk else [chunk]:
            if piece in self.special:
                out.append(self.special[piece])
                continue
            ascii_only = piece.isascii()
            for word in self._words(piece):
                if ascii_only:
                    word = word.translate(ASCII_BYTES)
                out += self.automaton.encode(word[:-1] + chr(ord(word[-1]) + LAST))
        return out

    def _miss(self, chunk: bytes) -> bytes:
        if (got := self.old.get(chunk)) is None:
            got = array("I", self.chunk_ids(chunk.decode("utf-8", "surrogatepass"))).tobytes()
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        if len(chunk) <= 64:
            self.young[chunk] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, miss = self.young.get, self._miss
        chunks = text_bytes(text).split()
        if len(self.young) + len(chunks) > CACHE:  # `get` holds on to the dictionary
            return b"".join([self.young.get(c) or miss(c) for c in chunks])
        return b"".join([get(c) or miss(c) for c in chunks])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs."""
        return " ".join(map(self.label.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One automaton, and one memory of chunks, for all tasks that a Python worker runs."""
    return WordBpe(path)


#: Control characters and space as the byte-level alphabet writes them: the 68 bytes outside its printable ranges count up from U+0100.
ASCII_BYTES = {b: chr(0x100 + k) for k, b in enumerate([*range(0x21), 0x7F])}


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids (binary, little-endian u32), decoded`` of every whole text."""
    path = vocabulary or tokenizer_path("word_bpe_49k.json")

    def make():
        bpe = word_bpe(path)

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            ids = [bpe.encode(t) for t in batch["text"]]
            return pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": [len(i) // 4 for i in ids], "ids": ids, "decoded": [*map(bpe.decode, ids)]})

        return each

    return map_batches(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids binary, decoded string", make)


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests taken inside the worker, so no token crosses to the JVM."""
    path = vocabulary or tokenizer_path("word_bpe_49k.json")

    def make():
        bpe = word_bpe(path)

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for text in batch["text"]:
                decoded = bpe.decode(ids := bpe.encode(text))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            return out

        return each

    return map_batches(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
