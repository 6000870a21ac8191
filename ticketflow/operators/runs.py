"""Rounds and runs: early stop, best round, comparison, choice, savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketflow.fixed_values import MONTHLY_COST, PATIENCE
from ticketflow.schema import RUN

COMPARED = (
    "accuracy",
    "f1_macro",
    "precision_macro",
    "recall_macro",
    "training_time_seconds",
    "peak_gpu_memory_mb",
    "total_parameters",
    "trainable_parameters",
    "trainable_percentage",
)


def _stale(history: DataFrame, run: str, metric: str) -> DataFrame:
    """history with ``_stale``, the epochs since the last strict improvement."""
    in_run = Window.partitionBy(run).orderBy("epoch")
    before = in_run.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_run.rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(metric).over(before)
    improved = F.when(best.isNull() | (F.col(metric) > best), F.row_number().over(in_run))
    stale = F.row_number().over(in_run) - F.max("_improved").over(upto)
    return history.withColumn("_improved", improved).withColumn("_stale", stale).drop("_improved")


def _stop(patience: int) -> tuple[Column, Column]:
    """Aggregates of a run: the first epoch with no patience left, and the last epoch."""
    return F.min(F.when(F.col("_stale") >= patience, F.col("epoch"))), F.max("epoch")


def early_stop(history: DataFrame, patience: int = PATIENCE, run: str = "run_id", metric: str = "f1_macro"):
    """``run, stop_epoch``: the first epoch that ends ``patience`` epochs in a
    row without a strict improvement, else the last epoch of the run."""
    return _stale(history, run, metric).groupBy(run).agg(F.coalesce(*_stop(patience)).alias("stop_epoch"))


def best_round(history: DataFrame, patience: int = PATIENCE, run: str = "run_id", metric: str = "f1_macro"):
    """``run, stop_epoch, best_epoch, metric``: the earliest best epoch among
    those before the stop. The history is read and shuffled once."""
    stop = F.coalesce(*[a.over(Window.partitionBy(run)) for a in _stop(patience)])
    best = F.max(F.struct(F.col(metric), (-F.col("epoch")).alias("_e"))).alias("_best")
    seen = _stale(history, run, metric).withColumn("stop_epoch", stop).filter("epoch <= stop_epoch")
    return seen.groupBy(run, "stop_epoch").agg(best).select(
        run, "stop_epoch", (-F.col("_best._e")).alias("best_epoch"), F.col(f"_best.{metric}").alias(metric)
    )


def run_record(spark: SparkSession, **fields) -> DataFrame:
    """One run as a row of the run table; fields not given are null."""
    total, trainable = fields.get("total_parameters"), fields.get("trainable_parameters")
    if total and trainable is not None:
        fields.setdefault("trainable_percentage", trainable / total * 100)
    unknown = set(fields) - set(RUN.names)
    if unknown:
        raise ValueError(f"unknown run fields: {sorted(unknown)}")
    return spark.createDataFrame([tuple(fields.get(n) for n in RUN.names)], RUN)


def compare_runs(runs: DataFrame, methods: list[str]) -> DataFrame:
    """``metric`` rows by method columns. The methods are named, so no extra
    pass looks for them."""
    values = [F.col(c).cast("double").alias(c) for c in COMPARED]
    tidy = runs.select("method", *values).unpivot("method", list(COMPARED), "metric", "value")
    return tidy.groupBy("metric").pivot("method", methods).agg(F.max("value"))


def choose_run(runs: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """The run with the best metric; then the shortest training time."""
    return runs.orderBy(F.desc_nulls_last(metric), F.asc_nulls_last("training_time_seconds"), "method").limit(1)


def roi(summary: DataFrame, monthly_cost: float = MONTHLY_COST) -> DataFrame:
    """Savings if the automatic share of the monthly cost falls away."""
    rate = F.col("automatic_pct") / 100.0
    return summary.select(
        rate.alias("automation_rate"),
        (F.lit(monthly_cost) * rate).alias("monthly_saving"),
        (F.lit(monthly_cost) * rate * 12).alias("annual_saving"),
    )
