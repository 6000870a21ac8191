"""Counts by class and split, previews and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.fixed_values import LABELS
from ticketflow.operators.labels import encode_label


def class_counts(df: DataFrame, col: str = "category", pct: bool = False) -> DataFrame:
    """Rows per class, largest first; null is no class. ``pct`` adds the share
    among the counted rows in percent."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    if pct:
        # one row per class
        counts = counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))
    return counts.orderBy(F.desc("n"), col)


def class_counts_by_split(df: DataFrame, col: str = "category", split: str = "split") -> DataFrame:
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(split, col)
        .agg(F.count("*").alias("n"))
        .orderBy(split, F.desc("n"), col)
    )


def row_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """``part, n``: one row per split and one named ``total``."""
    counts = df.groupBy(split).agg(F.count("*").alias("_n"))
    rolled = counts.rollup(split).agg(F.sum("_n").alias("n"), F.grouping(split).alias("_all"))
    part = F.when(F.col("_all") == 1, "total").otherwise(F.col(split))
    return rolled.filter("n is not null").select(part.alias("part"), "n")


def preview(df: DataFrame, n: int = 5, order: str = "pos") -> DataFrame:
    return df.orderBy(order).limit(n)


def to_labelled(
    df: DataFrame,
    labels: Sequence[str] = LABELS,
    text: str = "text",
    category: str = "category",
) -> DataFrame:
    """``text, label`` only; nothing else reaches a fit."""
    return encode_label(df.select(text, category), labels, category).select(
        F.col(text).alias("text"), F.col("label_id").alias("label")
    )
