"""Logits to probabilities, label, confidence and decision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketflow.fixed_values import AUTOMATIC, HUMAN_REVIEW, THRESHOLD


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row: lambdas would
    otherwise compute what they capture again for every array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifted_exp(logits: str | Column) -> Column:
    z = _col(logits).cast("array<double>")
    return _with(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))


def softmax(logits: str | Column) -> Column:
    """Softmax of an array of logits, shifted by its maximum."""
    return _with(
        _shifted_exp(logits),
        lambda e: _with(_sum(e), lambda total: F.transform(e, lambda x: x / total)),
    )


def max_probability(logits: str | Column) -> Column:
    """The largest softmax entry, without building the others."""
    return F.lit(1.0) / _sum(_shifted_exp(logits))


def argmax(arr: str | Column) -> Column:
    """Zero-based position of the largest entry; ties go to the lowest."""
    arr = _col(arr)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def decode(label_id: str | Column, labels: Sequence[str]) -> Column:
    """Label name of an id; null for an id outside the list."""
    return F.get(F.array(*[F.lit(name) for name in labels]), _col(label_id))


def decision(confidence: str | Column, threshold: float = THRESHOLD, inclusive: bool = False) -> Column:
    """``automatic`` above the threshold (or at it, if inclusive), else
    ``human_review``. Null and NaN go to a human."""
    c = _col(confidence)
    passed = c >= F.lit(threshold) if inclusive else c > F.lit(threshold)
    return F.when(c.isNotNull() & ~F.isnan(c) & passed, AUTOMATIC).otherwise(HUMAN_REVIEW)


def dot(left: str | Column, right: str | Column) -> Column:
    """Inner product of two arrays of numbers."""
    pairs = F.zip_with(_col(left), _col(right), lambda a, b: a.cast("double") * b.cast("double"))
    return _sum(pairs)
