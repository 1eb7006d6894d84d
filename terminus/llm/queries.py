"""Registered queries of the training-data operators: ``fn(spark, sf_dir)``.

Each applies its operator, with production parameters, to its whole table and
derives the digest columns that callers compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terminus.llm import (embedding_dedup, fingerprints, hard_negatives, html_text, language_id, lexical_search, licenses, mixing,
                          near_dedup, packing, repeats, token_counts, url_filters)
from terminus.llm.common import table


def op1_html_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", mixing.domain_of(F.col("source")))
    return mixing.mix(docs, names={}).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.evaluate(url_filters.page_captures(spark, sf_dir), url_filters.page_lists(spark, sf_dir))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_files(spark, sf_dir))


def op6_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"))


def op11_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kept = F.length("text").cast("bigint"), F.length("kept").cast("bigint")
    return repeats.strip_repeats(table(spark, sf_dir, "documents"), columns={
        "n_bytes": size, "n_removed": size - kept, "n_spans": F.size("spans").cast("bigint"), "kept_sha256": F.sha2("kept", 256)})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_suffix_array": op1_html_suffix_array,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op10_nnls_packing": op10_nnls_packing,
    "op4_url_filters": op4_url_filters,
    "op5_license_scans": op5_license_scans,
    "op6_prefix_fingerprints": op6_prefix_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_hierarchical_mixing": op9_hierarchical_mixing,
    "op11_best_position_search": op11_best_position_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_repeats": op13_suffix_repeats,
}

ORACLE: dict[str, str] = {
    "op4_url_filters": url_filters.oracle_sql(),
    "op9_hierarchical_mixing": mixing.oracle_sql(),
    "op11_best_position_search": lexical_search.oracle_sql(),
    "op12_hard_negatives": hard_negatives.oracle_sql(),
}
