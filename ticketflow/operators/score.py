"""Score tables: a fitted pipeline or any batch function, then the decision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.fixed_values import BATCH_SIZE, LABELS, THRESHOLD
from ticketflow.functions import scores
from ticketflow.operators.calibrate import RAW, calibrated


def decide(
    df: DataFrame, labels: Sequence[str], probs: str = "probs", threshold: float = THRESHOLD, inclusive: bool = False
) -> DataFrame:
    """Add ``prediction, confidence, decision`` from class probabilities. The
    decision uses the unrounded confidence."""
    df = df.withColumn("prediction", scores.decode(scores.argmax(probs), labels))
    return route(df.withColumn("confidence", F.array_max(probs)), threshold, inclusive)


def route(df: DataFrame, threshold: float = THRESHOLD, inclusive: bool = False) -> DataFrame:
    """Add ``decision`` from ``confidence``."""
    return df.withColumn("decision", scores.decision("confidence", threshold, inclusive))


def round_out(df: DataFrame, places: int = 4) -> DataFrame:
    """Round the confidence for output; do it after routing."""
    return df.withColumn("confidence", F.bround("confidence", places))


def model_labels(model: PipelineModel) -> list[str]:
    """The label list stored with the model."""
    return next(s.getLabels() for s in model.stages if isinstance(s, IndexToString))


def with_probabilities(model: PipelineModel, df: DataFrame, text: str = "text") -> DataFrame:
    """The input columns plus ``probs``; the model's own columns are dropped.
    An input column of a name that scoring adds must be renamed first."""
    clash = {"probs", "prediction", "confidence", "decision"} & set(df.columns)
    if clash:
        raise ValueError(f"rename {sorted(clash)} before scoring")
    out = model.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    return out.select(*df.columns, vector_to_array("_probability").alias("probs"))


def score(
    model: PipelineModel,
    df: DataFrame,
    text: str = "text",
    threshold: float = THRESHOLD,
    inclusive: bool = False,
    keep_probs: bool = False,
    calibration: IsotonicRegressionModel | None = None,
) -> DataFrame:
    """Add ``prediction, confidence, decision`` to a table or a stream, of one
    row or of many. With a ``calibration`` the confidence is the calibrated one, which decides, and the
    model's own is kept as ``raw_confidence``."""
    if calibration is not None and RAW in df.columns:
        raise ValueError(f"rename {RAW} before scoring")
    out = decide(with_probabilities(model, df, text), model_labels(model), "probs", threshold, inclusive)
    if calibration is not None:
        out = route(calibrated(calibration, out.drop("decision")), threshold, inclusive)
    return out if keep_probs else out.drop("probs")


def score_with(
    make_predict: Callable,
    df: DataFrame,
    inputs: Sequence[str],
    labels: Sequence[str] = LABELS,
    batch_size: int = BATCH_SIZE,
    input_shapes: Sequence | None = None,
    threshold: float = THRESHOLD,
    inclusive: bool = False,
    keep_probs: bool = False,
) -> DataFrame:
    """Score with a model from outside Spark.

    ``make_predict`` loads the model once per Python worker and returns a
    function from numpy batches of ``inputs`` to logits, one row per input.
    Array inputs need their ``input_shapes``.
    """
    predict = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )
    out = df.withColumn("_logits", predict(*inputs)).withColumn("probs", scores.softmax("_logits")).drop("_logits")
    out = decide(out, labels, "probs", threshold, inclusive)
    return out if keep_probs else out.drop("probs")


def prediction_record(scored: DataFrame, text: str = "text") -> DataFrame:
    """``text, category, confidence (4 places), status`` of scored rows."""
    return round_out(scored).select(
        F.col(text).alias("text"), F.col("prediction").alias("category"), "confidence", F.col("decision").alias("status")
    )
