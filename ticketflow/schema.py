"""Explicit schemas and small inline tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.fixed_values import CLASS_QUOTAS, LABELS, SLOTS, TEMPLATES

TICKET = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("annotator_confidence", T.IntegerType()),
    ]
)

SCORED = T.StructType(
    TICKET.fields
    + [
        T.StructField("prediction", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("decision", T.StringType()),
    ]
)

RUN = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("weighted", T.BooleanType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1_macro", T.DoubleType()),
        T.StructField("precision_macro", T.DoubleType()),
        T.StructField("recall_macro", T.DoubleType()),
        T.StructField("training_time_seconds", T.DoubleType()),
        T.StructField("peak_gpu_memory_mb", T.DoubleType()),
        T.StructField("total_parameters", T.LongType()),
        T.StructField("trainable_parameters", T.LongType()),
        T.StructField("trainable_percentage", T.DoubleType()),
        T.StructField("seed", T.LongType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1_macro", T.DoubleType()),
        T.StructField("precision_macro", T.DoubleType()),
        T.StructField("recall_macro", T.DoubleType()),
    ]
)

# A broadcast of this many rows (label sets, quotas, cut points) stays far
# below the executor memory; anything that could be larger is joined unhinted.
MAX_INLINE_ROWS = 10_000


def inline_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A driver-side constant as a local relation, so its size is known to the
    optimizer. Refuses anything above MAX_INLINE_ROWS."""
    table = pa.table(columns)
    if table.num_rows > MAX_INLINE_ROWS:
        raise ValueError(f"inline table of {table.num_rows} rows exceeds {MAX_INLINE_ROWS}")
    return spark.createDataFrame(table)


def label_dimension(spark: SparkSession, labels: Sequence[str] = LABELS) -> DataFrame:
    return inline_table(
        spark,
        {
            "label_id": pa.array(range(len(labels)), pa.int32()),
            "category": pa.array(labels, pa.string()),
        },
    )


def quota_table(spark: SparkSession, quotas: dict[str, int] = CLASS_QUOTAS, scale: int = 1) -> DataFrame:
    return inline_table(
        spark,
        {
            "ord": pa.array(range(len(quotas)), pa.int32()),
            "category": pa.array(list(quotas), pa.string()),
            "quota": pa.array([n * scale for n in quotas.values()], pa.int64()),
        },
    )


def template_table(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark,
        {
            "category": pa.array(list(TEMPLATES), pa.string()),
            "templates": pa.array([list(v) for v in TEMPLATES.values()], pa.list_(pa.string())),
        },
    )


def slot_arrays() -> dict[str, F.Column]:
    return {name: F.array(*[F.lit(v) for v in values]) for name, values in SLOTS.items()}
