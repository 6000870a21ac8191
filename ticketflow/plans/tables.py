"""The driver tables as the inputs this library works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels that stand in for ticket classes in the document table.
LANGUAGES = ("en", "fr", "de", "es")
RETURN_FLAGS = ("N", "R", "A")
EVENT_CLASSES = {
    "error": "technical",
    "signup": "account",
    "purchase": "billing",
    "view": "general",
    "click": "feature_request",
}
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the ticket schema; the language is the class."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("lang").alias("category"),
        (F.col("n_chars") % 4 + 2).cast("int").alias("annotator_confidence"),
    )


def scored_lines(spark: SparkSession, folder: str, confidence: Column | None = None) -> DataFrame:
    """Line items as a large scored table: the return flag is the truth, the
    discount gives a prediction (one that never says R) and a confidence, unless another is given."""
    given = F.lit(1.0) - F.col("l_discount") * F.col("l_tax") * 50 if confidence is None else confidence
    guess = F.when(F.col("l_discount") < 0.04, "A").when(F.col("l_discount") < 0.09, "N").otherwise("X")
    return table(spark, folder, "lineitem").select(
        *LINE_KEY,
        F.col("l_linestatus").alias("method"),
        F.col("l_returnflag").alias("truth"),
        guess.alias("prediction"),
        given.alias("confidence"),
    )


def quality_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Document labels as truth (quality) and prediction (not toxic)."""
    return table(spark, folder, "labels").select(
        "doc_id", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("prediction")
    )


def event_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """One ticket per event: its type says which ticket class it counts for."""
    cases = [F.when(F.col("event_type") == e, F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category")))
             for i, (e, c) in enumerate(EVENT_CLASSES.items())]
    return (
        table(spark, folder, "events")
        .select(F.coalesce(*cases).alias("c"))
        .groupBy("c.ord", "c.category")
        .agg(F.count("*").alias("quota"))
    )


def decision_stream_columns(events: DataFrame, *more: Column) -> DataFrame:
    """Events as timestamped decisions: the type is the prediction, and the
    truth is another one where the value is high."""
    truth = F.when(F.col("value") > 60, "error").otherwise(F.col("event_type"))
    # The table's times carry no zone; they are read as UTC in any session.
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return events.select("event_id", utc.alias("ts"), F.col("event_type").alias("prediction"), truth.alias("truth"), *more)
