"""Samples as JSON lines, reports as JSON and text, tables as Parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.errors import ValidationFailed

SAMPLE = "id string, data string, expectedTriggers map<string,boolean>, metadata struct<category:string,source:string,difficulty:string>"
DIFFICULTIES = ["easy", "medium", "hard"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table, through Spark's reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checked_samples(lines: DataFrame) -> DataFrame:
    """Samples of text lines (``value``) with ``errors``: what keeps a line from being one."""
    parsed = F.from_json("value", SAMPLE + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    out = lines.filter(F.trim("value") != "").select("value", parsed.alias("s"))
    s = F.col("s")
    errors = F.array(
        F.when(s["_corrupt"].isNotNull() | s.isNull(), "invalid JSON or field type"), F.when(s["id"].isNull(), "id must be a string"), F.when(s["data"].isNull(), "data is missing"),
        F.when(s["expectedTriggers"].isNull(), "expectedTriggers must be an object of booleans"),
        F.when(s["metadata"]["difficulty"].isNotNull() & ~s["metadata"]["difficulty"].isin(DIFFICULTIES), "difficulty must be easy, medium or hard"),
    )
    return out.select(
        F.col("s.id").alias("id"), F.col("s.data").alias("data"), F.col("s.expectedTriggers").alias("expected"), F.col("s.metadata.category").alias("category"),
        F.col("s.metadata.source").alias("source"), F.col("s.metadata.difficulty").alias("difficulty"), F.filter(errors, lambda e: e.isNotNull()).alias("errors"), "value",
    )


def load_samples(spark: SparkSession, path: str, show: int = 20) -> DataFrame:
    """Samples of a JSON-lines file; an error that names the bad lines if there are any (``show`` at most)."""
    rows = checked_samples(spark.read.text(path))
    bad = rows.filter(F.size("errors") > 0).select("value", "errors").limit(show).collect()
    if bad:
        raise ValidationFailed("invalid samples", lines=[{"line": r["value"], "errors": r["errors"]} for r in bad])
    return rows.drop("errors", "value")


def save_samples(samples: DataFrame, path: str) -> None:
    meta = F.struct("category", "source", "difficulty")
    samples.select("id", "data", F.col("expected").alias("expectedTriggers"), meta.alias("metadata")).write.mode("overwrite").json(path)


def save_report(metrics: DataFrame, details: DataFrame, path: str) -> None:
    """Metrics as JSON, details as JSON lines, and a text summary."""
    metrics.write.mode("overwrite").json(f"{path}/report")
    details.write.mode("overwrite").json(f"{path}/details")
    metrics.select(F.format_string("%s: precision %.3f recall %.3f f1 %.3f accuracy %.3f", "guardrail", "precision", "recall", "f1", "accuracy").alias("value")).write.mode("overwrite").text(f"{path}/summary")


#: Six samples to start from (text; expected pii, profanity and length; category, difficulty, source).
_WORDS = "word " * 999 + "word"
_SAMPLES = [
    ("This is a clean message with no issues.", (False, False, False), "clean", "easy", None),
    ("Contact me at john.doe@example.com or call 555-123-4567", (True, False, False), "pii", "easy", None),
    ("My SSN is 123-45-6789 and credit card is 4111-1111-1111-1111", (True, False, False), "pii", "medium", "synthetic"),
    ("This message contains badword1 and is offensive", (False, True, False), "profanity", "easy", None),
    (f"{_WORDS} {_WORDS}", (False, False, True), "length", "easy", None),
    (f"Email john@example.com about the badword1 issue {_WORDS}", (True, True, True), "multiple", "hard", None),
]
SAMPLES = [
    {
        "id": f"sample-{k}", "data": data, "expectedTriggers": dict(zip(("pii-detection", "profanity-filter", "content-length"), expected, strict=True)),
        "metadata": {"category": category, "difficulty": difficulty, "source": source},
    }
    for k, (data, expected, category, difficulty, source) in enumerate(_SAMPLES, 1)
]


def sample_dataset(spark: SparkSession) -> DataFrame:
    lines = spark.createDataFrame([(json.dumps(s),) for s in SAMPLES], "value string")
    return checked_samples(lines).drop("errors", "value")
