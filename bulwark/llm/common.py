"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch: bounds what a Python worker holds at a time.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder comes from ``spark.checkpoint.dir``.  Where neither that setting nor a folder of the context exists, a
    temporary one is set if the executors are threads of this very process (tests, a laptop); on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[0-9*, ]+\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small; texts may be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cut(batch: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    """A batch in pieces of ``rows`` rows at most: the session's setting may have changed since the plan was made."""
    for at in range(0, len(batch), rows):
        yield batch.iloc[at : at + rows].reset_index(drop=True)


def map_batches(
    df: DataFrame, columns: list[str | Column], schema: str, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
) -> DataFrame:
    """``make()`` runs once per task and returns the function applied to each Arrow batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = make()
        for batch in batches:
            for part in cut(batch, BATCH_ROWS):
                yield each(part)

    return df.select(*columns).mapInPandas(run, schema)


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text, null as empty; lone surrogates survive."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: ``BULWARK_TOKENIZERS`` or the installed package of them."""
    if folder := os.environ.get("BULWARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` (an inlined array would be re-evaluated in each lambda)."""
    return F.transform(F.array(value), use)[0]
