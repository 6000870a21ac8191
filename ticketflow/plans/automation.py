"""How much of a table would be automated, and how right would that be?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.operators.metrics import automation_summary, confusion, macro_metrics


def automation_quality(scored: DataFrame, by: str = "split") -> DataFrame:
    """``by, total, automatic, human_review``, their percentages, accuracy and
    macro figures of a scored table, from one count of its rows."""
    counts = confusion(scored, by=(by, "decision"))
    pairs = counts.groupBy(by, "truth", "prediction").agg(F.sum("n").alias("n"))
    return automation_summary(counts, by=(by,), rows="n").join(macro_metrics(pairs, by=(by,)), by)
