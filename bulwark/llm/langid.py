"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The model is trained by follow-the-regularised-leader with elastic-net penalties (per-coordinate rates, weights set to zero
below the L1 bound), then calibrated by one temperature on rows it was not trained on.

It is fitted on a bounded sample: of the rows whose ``crc32(doc_id) mod 3`` is not 1 and whose ``lang`` is not null, the
``SAMPLE`` with the smallest digest of their id, with their whole texts.  Only n-gram counts of these rows reach the driver,
and every row is then predicted from its whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no labelled rows every text is
``und``; with one label all texts get it; a null doc_id is hashed as an empty string, so it is not held out unless that
hash says so; very long texts are read whole, the count of one n-gram in a text being held at 65,535; repeated rows are predicted alike; lang and source never reach a prediction.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import map_batches

UNKNOWN = "und"
#: Rows that the classifier is fitted on at most.
SAMPLE = 3000
BUCKETS = 1 << 14
SIZES = (1, 2, 3)
#: Follow-the-regularised-leader: rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-5
EPOCHS, BATCH = 4, 16
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def buckets(text: str) -> np.ndarray:
    """Buckets of every character n-gram of the text, in lower case, runs of other than letters as one space."""
    text = f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, n, np.uint64)
                for k in range(n):
                    h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append((h >> np.uint64(7)).astype(np.int64) % BUCKETS)
    return np.concatenate(out)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        counts = np.bincount(buckets(text), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        x = counts[used] * self.idf[used]
        return (x / max(float(np.sqrt(x @ x)), 1e-12)) @ self.weights[used] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 1) -> Model:
    """Fit on sparse n-gram counts (buckets, counts) and labels; a tenth is kept for the temperature."""
    labels = sorted(set(langs))
    seen = np.zeros(BUCKETS)
    for at, _ in rows:
        seen[at] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    model = Model(labels, idf, np.zeros((BUCKETS, len(labels))), np.zeros(len(labels)))
    if len(labels) < 2:
        return model
    target = np.array([labels.index(g) for g in langs])
    features = []
    for at, counts in rows:
        x = counts * idf[at]
        features.append((at, x / max(float(np.sqrt(x @ x)), 1e-12)))
    order = np.random.default_rng(seed).permutation(len(rows))
    held, used = (order[: len(order) // 10], order[len(order) // 10 :]) if len(order) >= 50 else (order, order)
    z, n = np.zeros((BUCKETS + 1, len(labels))), np.zeros((BUCKETS + 1, len(labels)))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    rng = np.random.default_rng(seed + 1)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            at = np.unique(np.concatenate([features[i][0] for i in part] + [np.array([BUCKETS])]))
            w = weights(at)
            grad = np.zeros_like(w)
            for i in part:
                where = np.append(np.searchsorted(at, features[i][0]), len(at) - 1)
                x = np.append(features[i][1], 1.0)
                p = softmax(x @ w[where])
                p[target[i]] -= 1
                grad[where] += x[:, None] * p
            grad /= len(part)
            step = (np.sqrt(n[at] + grad**2) - np.sqrt(n[at])) / ALPHA
            z[at] += grad - step * w
            n[at] += grad**2
    every = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = every[:-1], every[-1]
    logits = np.array([features[i][1] @ model.weights[features[i][0]] + model.bias for i in held])
    model.temperature = calibrate(logits, target[held])
    return model


def calibrate(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(target)), target], 1e-12)).mean())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(docs: DataFrame):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier of ``docs``; n-gram counts of at most ``sample`` rows reach the driver.

    A cut on the digest, set from the number of labelled rows, thins them before anything is sorted.
    """
    known = docs.filter(~held_out(docs) & F.col("lang").isNotNull())
    share = min(1.0, (1.2 * sample + 100) / max(known.count(), 1))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = known.filter(F.col("text").isNotNull()).select("text", "lang", digest.alias("k")).filter(F.conv(F.substring("k", 1, 8), 16, 10).cast("long") <= int(share * 2**32))

    def make():
        def each(batch: pd.DataFrame) -> pd.DataFrame:
            rows = [np.unique(buckets(t), return_counts=True) for t in batch["text"]]
            return pd.DataFrame({"k": batch["k"], "lang": batch["lang"], "at": [r[0].astype("<u2").tobytes() for r in rows], "n": [np.minimum(r[1], 65535).astype("<u2").tobytes() for r in rows]})

        return each

    got = map_batches(drawn, ["k", "text", "lang"], "k string, lang string, at binary, n binary", make).orderBy("k", "lang", "at", "n").limit(sample).collect()
    rows = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u2").astype(float)) for r in got]
    return train(rows, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame([model.predict(t) for t in batch["text"]], columns=["lang_pred", "score"])
            ids = batch["doc_id"].astype("Int64")
            out.insert(0, "held_out", [zlib.crc32(b"" if pd.isna(i) else str(i).encode()) % 3 == 1 for i in ids])
            out.insert(0, "doc_id", ids.values)
            return out

        return each

    return map_batches(docs, ["doc_id", "text"], "doc_id long, held_out boolean, lang_pred string, score double", make)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows that are not held out, and predict every row."""
    return predict(docs, fit(docs, sample))
