"""Confidence that means what it says: isotonic calibration on held-out rows.

Right or wrong is regressed on the confidence under the one condition that a larger confidence is never
less often right. Rows are first combined into one record per distinct confidence, wherever they lie; Spark ML pools
adjacent violators in every range of confidences and once more over what is left. The pools
have strictly increasing shares of right rows, so n rows leave about n ** (2 / 3) of them at most, and usually some hundreds.
"""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW = "raw_confidence"


def usable(confidence: str = "confidence") -> Column:
    return F.col(confidence).isNotNull() & ~F.isnan(confidence)


def confidence_counts(
    df: DataFrame, truth: str = "truth", prediction: str = "prediction", confidence: str = "confidence"
) -> DataFrame:
    """``confidence, n, right`` per distinct confidence; rows without one are left out, and a missing truth or
    prediction counts as wrong."""
    right = F.coalesce(F.col(truth) == F.col(prediction), F.lit(False))
    # adding 0.0 makes one value of both zeros
    known = df.filter(usable(confidence)).select((F.col(confidence) + 0.0).alias("confidence"), right.alias("_right"))
    return known.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("_right").alias("right"))


def fit_calibration(
    validation: DataFrame, truth: str = "truth", prediction: str = "prediction", confidence: str = "confidence"
) -> IsotonicRegressionModel:
    """The calibration of scored rows with their truth, none of which the model was fitted on.

    Raises ValueError if no row has a confidence.
    """
    counts = confidence_counts(validation, truth, prediction, confidence)
    shares = counts.select(
        F.col("confidence").alias("_x"), (F.col("right") / F.col("n")).alias("_y"), F.col("n").cast("double").alias("_w")
    )
    if shares.isEmpty():
        raise ValueError("no row with a confidence to calibrate on")
    return IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="_calibrated").fit(shares)


def calibrated(model: IsotonicRegressionModel, df: DataFrame, confidence: str = "confidence", raw: str = RAW) -> DataFrame:
    """df with its confidence calibrated and the old one kept as ``raw``. Works on tables and streams.

    Between two confidences that the calibration has seen, it is linear; beyond them, constant. Missing confidences stay
    missing.
    """
    if raw in df.columns:
        raise ValueError(f"rename {raw} before calibrating")
    names = [c if c != confidence else raw for c in df.columns]
    seen = df.withColumnRenamed(confidence, raw).withColumn("_x", F.when(usable(raw), F.col(raw)).otherwise(0.0))
    out = model.transform(seen)
    return out.select(*names, F.when(usable(raw), F.col("_calibrated")).otherwise(F.col(raw)).alias(confidence))
