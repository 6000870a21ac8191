"""Split, store, fit, evaluate and record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ticketflow.fixed_values import LABELS, SEED
from ticketflow.operators import fit, metrics, score
from ticketflow.operators.split import TEST, TRAIN, VALIDATION, train_val_test_split
from ticketflow.sources.tickets import read_split, write_splits


def store_splits(
    df: DataFrame, path: str, labels: Sequence[str] = LABELS, seed: int = SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write a ticket table split 70/15/15 and return its parts as read back:
    a fit reads its rows many times, and the split is then computed once."""
    write_splits(train_val_test_split(df, seed=seed, labels=labels), path)
    parts = (read_split(df.sparkSession, path, name) for name in (TRAIN, VALIDATION, TEST))
    return tuple(parts)


def evaluated(result: fit.FitResult, test: DataFrame, model: str, method: str) -> DataFrame:
    """The run record of a fit, with its figures on the test rows."""
    scored = score.score(result.model, test).withColumnRenamed("category", "truth")
    return fit.record_of(result, metrics.macro_metrics(metrics.confusion(scored)), model, method)
