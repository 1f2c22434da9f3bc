"""Token counts by the whole-token shortcut.

A byte-level vocabulary splits text into pre-tokens and merges each by itself.  Offline, once for a vocabulary file, its
merges are run over every one of its own strings: those that come back as one token are *proven whole*.  A pre-token
among them counts one, by one lookup; only the rest is merged (and remembered for as long as memory allows).  Nothing is
shuffled: counts are made where the texts are read.

Text in Latin letters with common punctuation is split by a pattern whose classes are written out; any other text by the
vocabulary's own splitter, which is slower.  Long texts are split in pieces, cut before white space that follows something
else, where no pre-token ever reaches across.

Defined cases: null and empty texts have no bytes and no tokens; special strings inside a text count one, as the library
does by default; very long texts and words are counted whole, in time that grows as n log n in a word; repeated rows are
counted alike; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import map_batches, tokenizer_path

#: Texts of more tokens are over the limit.
LIMIT = 1024
#: Pre-tokens remembered by one Python worker in each of two generations, and the longest of them.
CACHE, CACHED_CHARS = 200_000, 64
#: Code points split at a time.
PIECE = 1 << 20

# Character classes of the splitter, written out for Latin text: U+0000 to U+02AF, general punctuation, currency signs.
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = re.compile("[\u0000-\u02af\u2000-\u206f\u20a0-\u20bf]*")
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
CUT = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")


def byte_alphabet() -> dict[str, int]:
    """Byte-level letters and the bytes they stand for: printable bytes stand for themselves, the others count up from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Merges:
    """The merge list of a byte-level vocabulary file, applied to one pre-token at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["model"].get("ignore_merges") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level vocabulary")
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.strings = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocab.items()}
        self.base = [self.strings[bytes([b])] for b in range(256)]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = {(vocab[u], vocab[v]): (rank, vocab[u + v]) for rank, (u, v) in enumerate(merges)}
        self.special = [x["content"] for x in spec["added_tokens"]]

    def tokens(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of the lowest rank merges first, the leftmost of equals."""
        ids: list[int | None] = [self.base[b] for b in word]
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, at) for at in range(n - 1) if (found := get((ids[at], ids[at + 1])))]
        heap = [(rank, at, merged, ids[at], ids[at + 1]) for rank, merged, at in heap]
        heapq.heapify(heap)
        while heap:
            _, at, merged, u, v = heapq.heappop(heap)
            right = after[at]
            if ids[at] != u or right >= n or ids[right] != v:
                continue  # one of the two has merged otherwise since
            ids[at], ids[right], after[at] = merged, None, after[right]
            if after[right] < n:
                before[after[right]] = at
                if found := get((merged, ids[after[at]])):
                    heapq.heappush(heap, (found[0], at, found[1], merged, ids[after[at]]))
            left = before[at]
            if left >= 0 and (found := get((ids[left], merged))):
                heapq.heappush(heap, (found[0], left, found[1], ids[left], merged))
        return [i for i in ids if i is not None]

    def whole(self) -> list[str]:
        """The vocabulary's strings proven to encode alone as one token: the merges end in that very token.

        Strings that are no whole UTF-8 can never be a pre-token's bytes and are left out.
        """
        proven = []
        for word, i in self.strings.items():
            if self.tokens(word) == [i]:
                try:
                    proven.append(word.decode("utf-8"))
                except UnicodeDecodeError:
                    continue
        return proven


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> list[str]:
    """The proof, made once by the driver for a file; as large as the vocabulary at most."""
    return merges_of(path).whole()


class TokenCounter:
    """Counts tokens of whole texts; ``whole`` holds the strings known to be one token."""

    def __init__(self, path: str, whole: list[str]):
        from tokenizers import Tokenizer

        self.merges, self.whole = merges_of(path), frozenset(whole)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.special = re.compile("|".join(map(re.escape, self.merges.special)) or r"(?!)")
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of a pre-token that isn't proven whole."""
        if (n := self.young.get(word)) is not None:
            return n
        if (n := self.old.get(word)) is None:
            n = len(self.merges.tokens(word.encode("utf-8", "surrogatepass")))
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        if len(word) <= CACHED_CHARS:
            self.young[word] = n
        return n

    def pre_tokens(self, piece: str) -> list[str]:
        if LATIN.fullmatch(piece):
            return PRE_TOKEN.findall(piece)
        return [piece[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(piece)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, at, whole = 0, 0, self.whole
        for part in self.special.finditer(text) if self.merges.special else ():
            total += self._plain(text[at : part.start()], whole) + 1
            at = part.end()
        return total + self._plain(text[at:] if at else text, whole)

    def _plain(self, text: str, whole: frozenset[str]) -> int:
        total = 0
        for piece in pieces(text):
            words = self.pre_tokens(piece)
            rest = [w for w in words if w not in whole]
            total += len(words) - len(rest) + sum(map(self.merged, rest))
        return total


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` code points, cut where no pre-token reaches across."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def counter(path: str, whole: tuple[str, ...]) -> TokenCounter:
    """One counter, and one memory of merged pre-tokens, for all tasks that a Python worker runs."""
    return TokenCounter(path, list(whole))


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    proof = docs.sparkSession.sparkContext.broadcast(tuple(whole_tokens(path)))  # bounded by the vocabulary

    def make():
        count = counter(path, proof.value).count

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": batch["n_bytes"], "n_tokens": [*map(count, batch["text"])]})

        return each

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = map_batches(docs, ["doc_id", "text", n_bytes], "doc_id long, n_bytes long, n_tokens long", make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
