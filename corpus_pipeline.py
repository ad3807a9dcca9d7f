"""From raw documents to token ids: quality, SimHash near-duplicates, benchmark copies, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontaminate, pii, quality, simhash
from gaugeworks.llm.common import table, vocabulary
from gaugeworks.session import shared_folder


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like others. Rows with a null ``doc_id`` stay; rows that repeat a ``doc_id`` go together if
    one of them is rejected. Columns may be called anything; an empty table gives an empty one.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest ``doc_id`` of each group that SimHash links join up, with the operator's shingle length
    and bit distance.

    Null and empty texts have fingerprint zero and make one group. Rows with a null ``doc_id`` stay; of rows that repeat one, one
    stays. Columns may be called anything; an empty table gives an empty one.
    """
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts and rows with a null ``doc_id`` stay; rows that repeat a ``doc_id`` go together. Columns may be called
    anything; an empty table gives an empty one.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with marks in place of personal data; ``n_chars`` follows the text.

    Every row stays, repeated ones and null ids too. Null texts stay null and keep their ``n_chars``; empty texts stay empty.
    Columns may be called anything; an empty table gives an empty one.
    """
    redacted = pii.redact(docs, pii.fit(docs))
    if "n_chars" not in redacted.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256): the ids of each text, and digests of them and of what they decode to.

    One row per row; null and empty texts have no ids; null ids and repeated rows pass through; an empty table gives an empty one.
    """
    trips = bpe.round_trip(docs, vocabulary("word_bpe_49k.json"))
    return bpe.digests(trips, "ids")


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("bpe encoding", as_tokens),
]
#: Neither a trained model nor the encoding can be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written down for the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        made = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(made)
        docs = spark.read.parquet(made)
    return docs
