"""Label ids and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.fixed_values import LABELS
from ticketflow.schema import label_dimension


def encode_label(df: DataFrame, labels: Sequence[str] = LABELS, col: str = "category") -> DataFrame:
    """Add ``label_id``; an unknown or null category gets null."""
    dim = label_dimension(df.sparkSession, labels).withColumnRenamed("category", col)
    return df.join(F.broadcast(dim), col, "left")


def decode_label(
    df: DataFrame, labels: Sequence[str] = LABELS, col: str = "label_id", name: str = "category"
) -> DataFrame:
    """Add the label ``name`` of an id; an id outside the list gets null."""
    dim = label_dimension(df.sparkSession, labels).select(
        F.col("label_id").alias(col), F.col("category").alias(name)
    )
    return df.join(F.broadcast(dim), col, "left")


def class_weights(df: DataFrame, labels: Sequence[str] = LABELS, col: str = "category") -> DataFrame:
    """``label_id, category, n, weight`` with weight = N / (K * n).

    N counts every row, also those of no known class. A label without rows
    has null n and weight. Give it the training rows only.
    """
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    listed = F.collect_list(F.when(F.col(col).isin(*labels), F.struct(F.col(col), F.col("n"))))
    gathered = counts.agg(F.sum("n").alias("_total"), F.map_from_entries(listed).alias("_by"))
    names = F.posexplode(F.array(*[F.lit(name) for name in labels])).alias("label_id", "category")
    return (
        gathered.select("_total", "_by", names)
        .withColumn("n", F.try_element_at("_by", "category"))
        .withColumn("weight", F.col("_total") / (F.lit(len(labels)) * F.col("n")))
        .select("label_id", "category", "n", "weight")
    )


def with_weight(df: DataFrame, weights: DataFrame, col: str = "category") -> DataFrame:
    """Add the class ``weight`` of each row; ``weights`` has one row per label."""
    per_class = weights.select(F.col("category").alias(col), "weight")
    return df.join(per_class, col, "left")
