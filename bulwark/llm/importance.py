"""Target-distribution importance resampling over hashed n-grams, by external sort-count.

The first pass tokenises each text once and writes *packs*: the buckets of several documents' n-grams as one stream of
uint16, with the documents' offsets in it.  Counting sorts each pack and run-length encodes it; a task merges its runs into
``BUCKETS`` numbers, and Spark adds those of all tasks.  From the counts of the corpus and of the target follow the gains,
one number a bucket.  The second pass reads the packs again, gathers gains by bucket and adds them up per document with
``np.add.reduceat``.  Texts are read once; packs take 4 bytes a word.

Documents are drawn by Gumbel noise that hangs on ``doc_id`` alone, so that reruns agree.  Ranks need no global order in
one task: rows are counted by score (whole numbers between fixed bounds), the counts are summed from the highest score
down, and only rows of one score are ordered among themselves.

Defined cases: null and empty texts have no features and weight 0; ASCII letters are lower-cased, no others; a null ``doc_id`` draws
noise as an empty id and comes last among ties; rows that repeat an id and a score are ranked one after the other; an empty target gains by the
smoothed corpus alone; other columns are not read; an empty table gives an empty result.  A text is cut into its words in slices of ``SLICE`` bytes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bulwark.llm.common import BATCH_ROWS, checkpointed, cut, small_batches, text_bytes

#: Buckets of hashed features; a bucket fits an unsigned 16-bit number.
BUCKETS = 10_000
#: Percent of the long enough documents that are drawn, words that make a document long enough, and the seed.
PERCENT, MIN_WORDS, SEED = 25, 20, 7
#: Bytes of a pack's stream from which the next document starts a new pack, and bytes of text cut into words at a time.
PACK, SLICE = 4 << 20, 1 << 20

#: Everything but ASCII letters, digits and the bytes of other characters is a space; A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def slices(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in slices of about ``size`` bytes, cut at spaces."""
    at = 0
    while len(data) - at > size and (end := data.find(b" ", at + size)) >= 0:
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def buckets(text: str | None, n_buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all one- and two-word features of a whole text, in no stated order."""
    parts, last = [], None
    for piece in slices(text_bytes(text).translate(WORD_BYTES), SLICE):
        if not (words := piece.split()):
            continue
        ones = [*map(zlib.crc32, words)]
        # the hash of "a b" goes on from that of "a" by a space and "b"
        before = ones[:-1] if last is None else [last, *ones[:-1]]
        twos = map(zlib.crc32, words if last is not None else words[1:], map(zlib.crc32, repeat(b" "), before))
        last = ones[-1]
        parts += [np.array(ones, np.int64), np.fromiter(twos, np.int64, len(before))]
    return (np.concatenate(parts) % n_buckets).astype(np.uint16) if parts else np.empty(0, np.uint16)


def packs(docs: DataFrame, n_buckets: int = BUCKETS, pack: int = PACK) -> DataFrame:
    """``doc_ids, offsets, stream``: packed little-endian buckets of some documents, and where each one's begin.

    ``doc_ids`` is an array in the documents' order; ``offsets`` counts features (int64) and has the stream's length at its end.
    """
    small_batches(docs.sparkSession)
    columns = ["doc_ids", "offsets", "stream"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int | None] = []
        streams: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype("<i8")
            return pd.DataFrame([(ids, offsets.tobytes(), np.concatenate(streams).astype("<u2").tobytes())], columns=columns)

        for batch in batches:
            for part in cut(batch, BATCH_ROWS):
                for doc_id, text in zip(part["doc_id"], part["text"]):
                    ids.append(doc_id)
                    streams.append(buckets(text, n_buckets))
                    held += 2 * len(streams[-1])
                    if held >= pack or len(ids) >= pack // 64:
                        yield flush()
                        ids, streams, held = [], [], 0
        if ids:
            yield flush()

    # ids travel as text: a null among numbers would turn them into floats
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts.mapInPandas(run, "doc_ids array<string>, offsets binary, stream binary")


def bucket_counts(packed: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: packs sorted and run-length encoded, runs merged by task, then by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for stream in batch["stream"]:
                ordered = np.sort(np.frombuffer(stream, "<u2"))
                starts = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + 1))
                totals[ordered[starts]] += np.diff(starts, append=len(ordered))
        found = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": found, "n": totals[found]})

    counted = packed.select("stream").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for bucket, n in counted.collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of how much likelier each bucket is in the target, add-one smoothed."""
    n = len(corpus)
    total, wanted = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * total / ((s + 1) * wanted))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_features, weight``: the floored mean of the gains of each document's features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, offsets, stream in zip(batch["doc_ids"], batch["offsets"], batch["stream"]):
                at = np.frombuffer(offsets, "<i8")
                n = np.diff(at)
                some = n > 0
                weight = np.zeros(len(n), np.int64)
                if some.any():  # documents without features would take the next one's first
                    sums = np.add.reduceat(gain[np.frombuffer(stream, "<u2")], at[:-1][some])
                    weight[some] = np.floor_divide(sums, n[some])
                yield pd.DataFrame({"doc_id": pd.array(ids, dtype="string"), "n_features": n, "weight": weight})

    out = packed.mapInPandas(run, "doc_id string, n_features long, weight long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from 32 bits of a digest of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``, null for what isn't drawn; ``n_features`` of n words are 2 n - 1."""
    enough = F.col("n_features") >= 2 * min_words - 1
    by_score = scored.filter(enough).groupBy("score").agg(F.count("*").alias("n"))
    # scores lie between fixed bounds: some ten thousands of rows, however many documents there are
    down = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    above = by_score.select("score", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("above"), F.floor(F.sum("n").over(W.partitionBy()) * percent / 100).alias("drawn"))
    above = checkpointed(above.filter(F.col("above") < F.col("drawn")))
    same = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    chosen = scored.filter(enough).join(above, "score")  # every row of a score that is drawn, in part or whole
    chosen = chosen.withColumn("rank", F.col("above") + F.row_number().over(same))
    chosen = chosen.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))).drop("above", "drawn")
    others = scored.join(above, "score", "left").filter(~enough | F.col("above").isNull()).drop("above", "drawn").withColumn("rank", F.lit(None).cast("long"))
    return chosen.unionByName(others)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, n_buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document of ``docs``, drawn to resemble the texts of ``target``."""
    packed = checkpointed(packs(docs, n_buckets))
    aim = packs(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n_buckets)
    gain = gains(bucket_counts(packed, n_buckets), bucket_counts(aim, n_buckets))
    scored = weights(packed, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(checkpointed(scored), percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that are drawn, with all their columns; rows that share an id are drawn by their number of features too."""
    chosen = importance_resample(docs, target, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("n_features").alias("__n")).distinct()
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.greatest(2 * words - 1, F.lit(0)) == F.col("__n")), "left_semi")


#: DuckDB's SQL for ``importance_resample`` over ``documents`` and ``benchmark``.  The CRC of a string is the exclusive or of one
#: number for each byte and its distance from the end, and of one for the length; both come from a table made by the recursion.
SQL = rf"""
WITH RECURSIVE
z AS (SELECT 0 AS k, b, (SELECT list_reduce(CAST(range(8) AS BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b)) AS v FROM (SELECT unnest(CAST(range(256) AS BIGINT[])) AS b)),
longest AS (SELECT max(strlen(w)) AS m FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark))),
shifted AS (
  SELECT k, b, v FROM z
  UNION ALL
  SELECT s.k + 1, s.b, xor(s.v >> 8, t.v) FROM shifted AS s JOIN z AS t ON t.b = s.v & 255 WHERE s.k < (SELECT 2 * m + 1 FROM longest)
),
start AS (
  SELECT 0 AS n, CAST(4294967295 AS BIGINT) AS v
  UNION ALL
  SELECT s.n + 1, xor(s.v >> 8, t.v) FROM start AS s JOIN z AS t ON t.b = s.v & 255 WHERE s.n < (SELECT 2 * m + 2 FROM longest)
),
texts AS (SELECT row_number() OVER () AS r, doc_id, text, true AS own FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
lists AS (SELECT r, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
words AS (SELECT r, own, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
features AS (
  SELECT r, own, w AS f FROM words
  UNION ALL
  SELECT a.r, a.own, a.w || ' ' || b.w FROM words AS a JOIN words AS b ON a.r = b.r AND b.i = a.i + 1
),
per AS (SELECT r, own, f, count(*) AS n FROM features GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS x, strlen(f) AS n FROM (SELECT DISTINCT f FROM per)),
bytes AS (SELECT f, n, unnest(range(n)) AS i, x FROM hexed),
hashed AS (
  SELECT f, xor(xor(bit_xor(s.v), any_value(t.v)), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT f, n, n - 1 - i AS k, (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 AS b FROM bytes) AS y
  JOIN shifted AS s ON s.k = y.k AND s.b = y.b JOIN start AS t ON t.n = y.n GROUP BY f
),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM per JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (total + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (wanted + {BUCKETS})::DOUBLE))) AS BIGINT) AS g
  FROM counts, (SELECT coalesce(sum(s), 0) AS total, coalesce(sum(t), 0) AS wanted FROM counts)
),
weighed AS (SELECT r, sum(n) AS n_features, floor(sum(n * g)::DOUBLE / sum(n)) AS weight FROM per JOIN hashed USING (f) JOIN gain USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE own
),
placed AS (
  SELECT *, n_features >= {2 * MIN_WORDS - 1} AS enough, row_number() OVER (PARTITION BY n_features >= {2 * MIN_WORDS - 1} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) FILTER (n_features >= {2 * MIN_WORDS - 1}) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= ({PERCENT} * n) // 100 THEN place END AS rank FROM placed
"""
