"""Generate labelled ticket tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketflow.fixed_values import (
    CONFIDENT_CLASSES,
    CONFIDENT_VALUES,
    CONFIDENT_WEIGHTS,
    OTHER_VALUES,
    OTHER_WEIGHTS,
    SEED,
)
from ticketflow.functions.draws import draw, fill_slots, hash_hex, pick, weighted_choice
from ticketflow.operators.rank import with_position
from ticketflow.schema import quota_table, slot_arrays, template_table

CHUNK = 65_536


def expand_quota(quotas: DataFrame) -> DataFrame:
    """``id, category``: ``quota`` rows per class, ids from 1 in ``ord`` order.

    Input is one row per class (``ord, category, quota``). Each class is cut
    into chunks that are spread over the cluster before they become rows, so
    one dominant class is not one task.
    """
    # An explicit number, because adaptive execution would merge partitions that
    # are small before their rows are generated.
    tasks = int(quotas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    earlier = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        quotas.withColumn("_first", F.coalesce(F.sum("quota").over(earlier), F.lit(0)))
        .filter("quota > 0")
        .select(
            "category",
            "quota",
            "_first",
            F.explode(F.expr(f"sequence(0L, (quota - 1) div {CHUNK})")).alias("_chunk"),
        )
        .repartition(tasks, "category", "_chunk")
    )
    row = F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least(quota, (_chunk + 1) * {CHUNK}) - 1)"))
    return chunks.select("category", "_first", row.alias("_row")).select(
        (F.col("_first") + F.col("_row") + 1).alias("id"), "category"
    )


def fill_template(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``text``: a template of the row's class with its slot filled."""
    return (
        df.join(F.broadcast(template_table(df.sparkSession)), "category", "left")
        .withColumn("_template", pick("templates", draw(seed, "template", "id")))
        .withColumn("_u", draw(seed, "slot", "id"))
        .withColumn("text", fill_slots("_template", slot_arrays(), F.col("_u")))
        .drop("templates", "_template", "_u")
    )


def annotate_confidence(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``annotator_confidence``, drawn by class."""
    u = F.col("_u")
    value = F.when(
        F.col("category").isin(*CONFIDENT_CLASSES),
        weighted_choice(CONFIDENT_VALUES, CONFIDENT_WEIGHTS, u),
    ).otherwise(weighted_choice(OTHER_VALUES, OTHER_WEIGHTS, u))
    return (
        df.withColumn("_u", draw(seed, "confidence", "id"))
        .withColumn("annotator_confidence", value.cast("int"))
        .drop("_u")
    )


def shuffle_rows(df: DataFrame, seed: int = SEED, key: str = "id") -> DataFrame:
    """Add ``pos``, the row's place in a seeded random order of the table."""
    return with_position(df, hash_hex(seed, "shuffle", key))


def tickets_from_quota(quotas: DataFrame, seed: int = SEED) -> DataFrame:
    """Tickets for any quota table, in the ticket schema plus ``pos``."""
    rows = annotate_confidence(fill_template(expand_quota(quotas), seed), seed)
    return shuffle_rows(rows, seed).select("id", "text", "category", "annotator_confidence", "pos")


def synthesize_tickets(spark: SparkSession, seed: int = SEED, scale: int = 1) -> DataFrame:
    """The standard 5,000-ticket table, or a multiple of it."""
    return tickets_from_quota(quota_table(spark, scale=scale), seed)
