"""Quality rules: base counts, and tokeniser fertility under public vocabularies.

Fertility is measured on the whole text, split at ASCII white space, under two vocabularies: pieces that fall back to
bytes, and byte-level merges learnt from many languages, where a token that cuts a character up counts as a byte.
Each gives code points per token, share of tokens that are bytes, and the entropy of the token distribution.
A document is rejected when one of the six leaves the band of its language (when ``bands`` has it) or of
its dominant script.  What one vocabulary writes in bytes the other may know: text decoded with the wrong
character set passes for accented Latin under the first and falls to bytes under the second.  Short texts scatter more, so the lower limit of code points per token is relaxed by ``slack``
over the root of the number of tokens; token entropy grows with length, so its lower limit is compared with the
entropy divided by the logarithm of the number of tokens.

Null texts have no words: every count is 0, ``base_failed`` is true and the document is rejected.
Very long texts are measured whole; repeated rows are measured separately; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from bulwark.llm.common import map_batches, small_batches, text_bytes, tokenizer_path

MIN_WORDS = 50
#: Per cent of the words that may stand in repeated 3-word windows.
MAX_REPEAT = 50
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
LETTER = re.compile(rb"[A-Za-z]")
CACHE = 120_000


@dataclass(frozen=True)
class Band:
    """Limits that a document's fertility must keep."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy_share: float
    slack: float = 3.4


#: Pieces with byte fallback, and byte-level merges for many languages.
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pattern that byte-level merges do not cross.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: By language, else by script: a band for each vocabulary.  Where a vocabulary hardly has a script, its band is wide.
#: ``other`` has letters of no script below, which both vocabularies may write in bytes; ``none`` has no letter.
BANDS = {
    "en": (Band(2.10, 8.0, 0.10, 0.35), Band(1.30, 8.0, 0.20, 0.30)),
    "de": (Band(2.10, 8.0, 0.10, 0.35), Band(1.30, 8.0, 0.20, 0.30)),
    "fr": (Band(1.90, 8.0, 0.10, 0.35), Band(1.30, 8.0, 0.20, 0.30)),
    "es": (Band(1.83, 8.0, 0.10, 0.35), Band(1.30, 8.0, 0.20, 0.30)),
    "latin": (Band(1.35, 8.0, 0.20, 0.35), Band(1.10, 8.0, 0.30, 0.30)),
    "greek": (Band(0.65, 6.0, 0.45, 0.35), Band(0.90, 6.0, 0.45, 0.30)),
    "cyrillic": (Band(0.80, 8.0, 0.40, 0.35), Band(1.00, 8.0, 0.45, 0.30)),
    "armenian": (Band(0.58, 8.0, 0.50, 0.35), Band(0.45, 8.0, 0.92, 0.30)),
    "hebrew": (Band(0.62, 8.0, 0.40, 0.35), Band(0.85, 8.0, 0.50, 0.30)),
    "arabic": (Band(0.60, 8.0, 0.45, 0.35), Band(0.85, 8.0, 0.55, 0.30)),
    "devanagari": (Band(0.50, 8.0, 0.50, 0.35), Band(0.55, 8.0, 0.80, 0.30)),
    "bengali": (Band(0.45, 8.0, 0.55, 0.35), Band(0.30, 8.0, 1.00, 0.30)),
    "tamil": (Band(0.45, 8.0, 0.55, 0.35), Band(0.70, 8.0, 0.50, 0.30)),
    "thai": (Band(0.60, 8.0, 0.45, 0.35), Band(0.75, 8.0, 0.50, 0.30)),
    "georgian": (Band(0.55, 8.0, 0.45, 0.35), Band(0.25, 8.0, 1.00, 0.25)),
    "cjk": (Band(0.36, 4.0, 0.80, 0.35), Band(0.48, 4.0, 0.80, 0.30)),
    "other": (Band(0.20, 8.0, 1.00, 0.30), Band(0.20, 8.0, 1.00, 0.25)),
    "none": (Band(0.20, 8.0, 0.60, 0.25), Band(0.20, 8.0, 0.70, 0.25)),
}
#: First and last code point of the ranges that decide a script.
RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x587)],
    "hebrew": [(0x5D0, 0x5EA)],
    "arabic": [(0x620, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFEFC)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "cjk": [(0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0x20000, 0x323AF)],
}


def script_of(text: str) -> str:
    """The script that most letters of the text belong to; ``other`` if it has letters of none of them, ``none`` without letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    beyond = codes[codes > RANGES["latin"][-1][1]]
    counts = {name: sum(int(((c >= a) & (c <= b)).sum()) for a, b in spans) for name, spans in RANGES.items() for c in [codes if name == "latin" else beyond]}
    best = max(counts, key=counts.get)
    if counts[best]:
        return best
    return "other" if any(map(str.isalpha, text)) else "none"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    code = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        window = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ code[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


class Pieces:
    """A vocabulary of pieces that falls back to bytes; each distinct word is encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())], bool)
        self.code = "H" if len(self.is_byte) <= 1 << 16 else "I"
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Encode, in one call, the words of a batch that are not remembered."""
        if len(self.known) > CACHE:
            self.known = {}
        new = list(words - self.known.keys())
        for word, ids in zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new]), strict=True):
            self.known[word] = array(self.code, ids).tobytes()

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), self.code)


class Merges:
    """Byte-level merges, over the words with a space before each; a token of no whole characters counts as a byte."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
        self.is_byte[[rank for token, rank in ranks.items() if "\ufffd" in token.decode("utf-8", "replace")]] = True

    def learn(self, words: set[bytes]) -> None:
        """Nothing is remembered: a text is encoded faster than its words are looked up."""

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(b" ".join([b"", *words]).decode("utf-8", "replace")), np.uint32)


def fertility(vocabulary: Pieces | Merges, words: list[bytes]) -> tuple[int, int, float]:
    """Tokens, tokens that are bytes, and entropy of the tokens in bits; the vocabulary has learnt the words."""
    ids = vocabulary.ids(words)
    if not len(ids):
        return 0, 0, 0.0
    size = len(vocabulary.is_byte)
    counts = np.bincount(ids, minlength=size) if len(ids) > 2000 else np.unique(ids, return_counts=True)[1]
    share = counts[counts > 0] / len(ids)
    return len(ids), int(vocabulary.is_byte[ids].sum()), float(-(share * np.log2(share)).sum())


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> Pieces | Merges:
    """One vocabulary, and one memory of words, for all tasks that a Python worker runs."""
    return (Merges if path.endswith(".tiktoken") else Pieces)(path)


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean",
    "script": "string", "n_tokens": "long", "chars_per_token": "double", "byte_share": "double", "token_entropy": "double",
    "n_tokens_2": "long", "chars_per_token_2": "double", "byte_share_2": "double", "token_entropy_2": "double",
}


def within(band: Band, tokens: int, per_token: float, byte_share: float, entropy: float) -> bool:
    return (
        band.min_chars_per_token - band.slack / math.sqrt(max(tokens, 1)) <= per_token <= band.max_chars_per_token
        and byte_share <= band.max_byte_share
        and entropy >= band.min_entropy_share * math.log2(max(tokens, 2))
    )


def measure(raw: bytes, words: list[bytes], lang: str | None, vocabularies: list[Pieces | Merges], bands: dict[str, tuple[Band, ...]]) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    n, chars = len(words), sum(map(len, words))
    if not raw.isascii():
        chars = len(text := raw.decode("utf-8", "surrogatepass")) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
    script = ("latin" if LETTER.search(raw) else "none") if raw.isascii() else script_of(text)
    found = []
    for vocabulary in vocabularies:
        tokens, fallback, entropy = fertility(vocabulary, words)
        found.append((tokens, chars / max(tokens, 1), fallback / max(tokens, 1), entropy))
    kept = not failed and all(within(band, *f) for band, f in zip(bands.get(lang) or bands[script], found, strict=True))
    symbols = len(raw.translate(None, NOT_SYMBOLS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, kept, script, *(x for f in found for x in f)


def _measured(batch: pd.DataFrame, vocabularies: list[Pieces | Merges], bands: dict[str, tuple[Band, ...]]) -> list[tuple]:
    raw = [text_bytes(t) for t in batch["text"]]
    words = [r.split() for r in raw]
    distinct = set().union(*words)
    for vocabulary in vocabularies:
        vocabulary.learn(distinct)
    return [measure(r, w, g, vocabularies, bands) for r, w, g in zip(raw, words, batch["lang"], strict=True)]


def quality_rules(docs: DataFrame, bands: dict[str, tuple[Band, Band]] | None = None, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id`` and ``COLUMNS`` of every document, from its whole text; ``vocabularies`` are two paths."""
    paths = vocabularies or [*map(tokenizer_path, VOCABULARIES)]
    bands = BANDS | (bands or {})

    def make():
        known = [*map(vocabulary_of, paths)]

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame(_measured(batch, known, bands), columns=[*COLUMNS])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            return out

        return each

    return map_batches(docs, ["doc_id", "text", "lang"], "doc_id long, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items()), make)


def keep_good(docs: DataFrame, bands: dict[str, tuple[Band, Band]] | None = None, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """The documents that the rules keep, with all their columns; no shuffle."""
    paths = vocabularies or [*map(tokenizer_path, VOCABULARIES)]
    bands = BANDS | (bands or {})
    kept = [*COLUMNS].index("kept")
    small_batches(docs.sparkSession)

    def run(batches):
        known = [*map(vocabulary_of, paths)]
        for batch in batches:
            texts = pd.DataFrame({c: batch.column(c).to_pylist() for c in ("text", "lang")})
            yield batch.filter(pa.array([x[kept] for x in _measured(texts, known, bands)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
