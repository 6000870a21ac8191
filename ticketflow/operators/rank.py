"""Exact ranks by hash without putting a whole class into one task.

A hash prefix cuts each group into up to 16**PREFIX even buckets. Counting the
buckets gives every bucket its offset, so a rank needs only the rows of one
bucket, however large the group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 4


def bucket(h: F.Column) -> F.Column:
    return F.substring(h, 1, PREFIX)


def bucket_bounds(keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, _bucket, _below, _size`` from a frame with ``by`` and ``_bucket``."""
    counts = keys.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_below", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))


def with_position(df: DataFrame, order: F.Column, name: str = "pos") -> DataFrame:
    """A dense position from 0 over the whole table, in ``order`` of a hash.

    The broadcast bounds hold at most 16**PREFIX rows. Rows move once, to
    their bucket.
    """
    keyed = df.withColumn("_h", order).withColumn("_bucket", bucket(F.col("_h")))
    bounds = bucket_bounds(keyed.select("_bucket"), by=[])
    within = Window.partitionBy("_bucket").orderBy("_h")
    return (
        keyed.join(F.broadcast(bounds.drop("_size")), "_bucket")
        .withColumn(name, F.col("_below") + F.row_number().over(within) - 1)
        .drop("_h", "_bucket", "_below")
    )
