"""Run records as JSON, and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession

from ticketflow.schema import RUN


def append_run(df: DataFrame, path: str) -> None:
    df.select(*RUN.names).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Run records; ``multi_line`` reads a file that holds one indented object."""
    return spark.read.schema(RUN).option("multiLine", multi_line).json(path)


def save_model(model: PipelineModel | IsotonicRegressionModel, path: str) -> None:
    """Features, classifier and label list together."""
    model.write().overwrite().save(path)


def load_calibration(path: str) -> IsotonicRegressionModel:
    return IsotonicRegressionModel.load(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
