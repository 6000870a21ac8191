"""The same scoring and monitoring on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ticketflow.fixed_values import THRESHOLD
from ticketflow.operators.score import score
from ticketflow.schema import TICKET


def read_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = TICKET,
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def score_stream(
    model: PipelineModel,
    stream: DataFrame,
    text: str = "text",
    threshold: float = THRESHOLD,
    inclusive: bool = False,
    calibration: IsotonicRegressionModel | None = None,
) -> DataFrame:
    """Scored stream; no state is kept, rows are independent."""
    return score(model, stream, text, threshold, inclusive, calibration=calibration)


def write_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    every: str | None = None,
) -> StreamingQuery:
    """Start a file sink. Without ``every`` it handles what is there and ends."""
    writer = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.outputMode("append").trigger(**trigger).start()


def write_latest(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a sink for a whole result table: after each batch, a folder
    ``path/<batch>`` holds all of it. Ends when what is there is handled."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:010d}")

    writer = df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.outputMode("complete").trigger(availableNow=True).start()


def drift(
    df: DataFrame,
    classes: Sequence[str],
    window: str = "1 day",
    late: str = "1 hour",
    ts: str = "ts",
    prediction: str = "prediction",
    truth: str | None = None,
) -> DataFrame:
    """Per tumbling window: rows, share of each class and, with a truth column,
    the error rate. Works on tables and streams. A stream written in append mode (write_stream) gives a window when
    it has closed and drops its state; rows later than ``late`` behind the newest are then dropped. In complete
    mode (write_latest) every window stays open: nothing is dropped, and the state grows with the windows.
    """
    p = F.col(prediction)
    shares = [(F.count_if(p == name) / F.count("*")).alias(f"share_{name}") for name in classes]
    if truth is not None:
        wrong = F.coalesce(p != F.col(truth), F.lit(True))
        shares.append((F.count_if(wrong) / F.count("*")).alias("error_rate"))
    return (
        df.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("_w"))
        .agg(F.count("*").alias("n"), *shares)
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n", *[
            f"share_{name}" for name in classes
        ], *(["error_rate"] if truth is not None else []))
    )
