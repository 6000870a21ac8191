"""The threshold as a choice: exact figures at every confidence that occurs, and the smallest threshold that keeps a promise.

Figures at a threshold are sums over all larger confidences. Rows are combined into one record per distinct
confidence; those are cut into ranges, sums run inside every range, and the totals of the ranges, a few hundred
rows, give each its offset. No task sees all confidences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.operators.calibrate import confidence_counts

RANGES = 128


def _range(bounds: list[float]) -> Column:
    """How many of the bounds, a few, lie at or below the confidence."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("confidence"))) if bounds else F.lit(0)


def running_counts(counts: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``confidence, n, right`` per distinct confidence to the same with ``n_above, right_above`` (sums over all larger
    confidences), and the totals ``total, total_right``. The ranges come from a sketch of the confidences, one more
    pass over counts; how good they are decides how even the tasks are, not the result."""
    at = [i / ranges for i in range(1, ranges)]
    found = counts.agg(F.percentile_approx("confidence", at, 10 * ranges).alias("b")).first().b if at else None
    ranged = counts.withColumn("_range", _range(sorted(set(found or []))))
    sums = ranged.groupBy("_range").agg(F.sum("n").alias("_n"), F.sum("right").alias("_right"))
    # at most `ranges` rows from here on
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "_range",
        F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_right").over(later), F.lit(0)).alias("_right0"),
        F.sum("_n").over(every).alias("total"),
        F.sum("_right").over(every).alias("total_right"),
    )
    above = Window.partitionBy("_range").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "_range").select(
        "confidence", "n", "right",
        (F.coalesce(F.sum("n").over(above), F.lit(0)) + F.col("_n0")).alias("n_above"),
        (F.coalesce(F.sum("right").over(above), F.lit(0)) + F.col("_right0")).alias("right_above"),
        "total", "total_right",
    )


def threshold_curve(
    df: DataFrame,
    truth: str = "truth",
    prediction: str = "prediction",
    confidence: str = "confidence",
    inclusive: bool = False,
    ranges: int = RANGES,
) -> DataFrame:
    """``threshold, automatic, coverage, precision, recall`` at every distinct confidence.

    A row is automatic if its confidence is above the threshold, or at it with ``inclusive``. Coverage is the automatic share of the rows
    that have a confidence, precision the right share of the automatic ones (null if there are none), recall the automatic
    share of the right ones.
    """
    counts = confidence_counts(df, truth, prediction, confidence)
    sums = running_counts(counts, ranges)
    n = F.col("n_above") + (F.col("n") if inclusive else 0)
    right = F.col("right_above") + (F.col("right") if inclusive else 0)
    return sums.select(
        F.col("confidence").alias("threshold"),
        n.alias("automatic"),
        (n / F.col("total")).alias("coverage"),
        F.try_divide(right, n).alias("precision"),
        F.try_divide(right, F.col("total_right")).alias("recall"),
    )


def choose_threshold(curve: DataFrame, precision: float) -> DataFrame:
    """The line of the smallest threshold whose precision is ``precision`` or more: the most automation that keeps
    the promise. One row; all null if no threshold does."""
    best = F.min(F.when(F.col("precision") >= precision, F.struct(*curve.columns)))
    return curve.agg(best.alias("_best")).select("_best.*")


def ranking_quality(
    df: DataFrame,
    truth: str = "truth",
    prediction: str = "prediction",
    confidence: str = "confidence",
    ranges: int = RANGES,
) -> DataFrame:
    """``n, right, auc``: how often a right row has a larger confidence than a wrong one, ties counting half; exact."""
    counts = confidence_counts(df, truth, prediction, confidence)
    sums = running_counts(counts, ranges)
    wrong = (F.col("n") - F.col("right")).cast("decimal(38,0)")
    twice = F.sum(wrong * (2 * F.col("right_above") + F.col("right")))
    pairs = F.sum("right").cast("decimal(38,0)") * F.sum(wrong)
    return sums.agg(
        F.sum("n").alias("n"), F.sum("right").alias("right"), F.try_divide(twice.cast("double"), (2 * pairs).cast("double")).alias("auc")
    )
