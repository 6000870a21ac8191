"""Documents to packed training sequences, in five stages.

Each stage takes what the one before kept, written as Parquet, and all but the last
return the columns of documents. Null texts count as empty, which the classifier may reject; null ids and sources are kept as
they are; of rows that repeat a text one stays. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketflow.llm import exact, mixing, packing, quality, simhash
from ticketflow.llm.queries import WORD_TOKENIZER
from ticketflow.llm.tables import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones that are not held out, accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact.drop_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.packed(docs, WORD_TOKENIZER)


STAGES = [("quality", good), ("exact dedup", distinct), ("near dedup", unlike), ("mixing", mixed), ("packing", packed)]

#: SQL has neither the compressor nor the tokenizer; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "_"))
    return docs
