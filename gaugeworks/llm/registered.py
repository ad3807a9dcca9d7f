"""The driver's queries of the training-data operators: (spark, folder) to a DataFrame."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import (
    bpe,
    collocations,
    decontaminate,
    html_text,
    packing,
    pii,
    quality,
    repair,
    simhash,
    token_counts,
    token_store,
    top_k,
    url_filter,
)
from gaugeworks.llm.common import table, vocabulary


def op1_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return pii.digests(pii.find(documents, pii.fit(documents)))


def op3_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json")))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.store_and_read_back(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), 2)


def op6_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_benchmark_copies(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_top_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.search(table(spark, folder, "embeddings"))


def op9_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


def op11_repaired_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(table(spark, folder, "conversations"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


def op13_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), 2)


QUERIES = {
    run.__name__: run
    for run in (
        op1_simhash_near_duplicates,
        op2_personal_data,
        op3_bpe_round_trip,
        op4_token_counts,
        op5_token_files,
        op6_quality_scores,
        op7_benchmark_copies,
        op8_top_inner_products,
        op9_url_verdicts,
        op10_main_text,
        op11_repaired_conversations,
        op12_collocations,
        op13_packed_sequences,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {
    "op8_top_inner_products": top_k.oracle(),
    "op9_url_verdicts": url_filter.oracle(),
    "op12_collocations": collocations.oracle(),
}
