"""The corpus pipeline: five stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bulwark.llm import bpe, line_dedup, mixing, ngram_join, quality
from bulwark.llm.common import checkpointed, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that spread over many sites."""
    return line_dedup.clean_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links form."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: Fertility and merges are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each stage's rows are written to the checkpoint folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
