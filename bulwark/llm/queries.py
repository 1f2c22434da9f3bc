"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bulwark.llm import bpe, conversation_trie, exact_dedup, html_text, importance, langid, licenses, line_dedup, mixing, ngram_join, pii, quality, token_counts
from bulwark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_personal_data, op2_source_mix, op3_bpe_automaton, op4_license_scan, op5_ngram_join, op6_language_id, op7_page_text, op8_quality_rules, op9_line_dedup, op10_exact_dedup, op11_token_counts, op12_conversation_trie, op13_importance_resample)}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": mixing.SQL, "op9_line_dedup": line_dedup.SQL, "op10_exact_dedup": exact_dedup.SQL, "op12_conversation_trie": conversation_trie.SQL, "op13_importance_resample": importance.SQL}
