"""How sure a figure is: Poisson bootstrap of evaluation metrics, in one scan.

Every row stands in every replicate as often as a Poisson variable of mean 1 says, drawn from a hash of its key:
the rows of a replicate need not be drawn together, so a table of any size is read once, and
counts of (replicate, truth, prediction) are combined before the shuffle. Reruns give the same figures.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.fixed_values import SEED
from ticketflow.operators.metrics import macro_metrics

#: Bits of a draw, and draws that one hash of 128 bits gives.
DRAW_BITS, DRAWS = 15, 8
#: A draw below the first bound counts 0, below the second 1, and so on: the distribution of a Poisson variable of mean 1.
BOUNDS = [math.floor(2**DRAW_BITS * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) + 0.5) for n in range(7)]
METRICS = ("accuracy", "f1_macro", "precision_macro", "recall_macro")


def poisson(draw: Column) -> Column:
    weight = F.lit(len(BOUNDS))
    for n, bound in reversed(list(enumerate(BOUNDS))):
        weight = F.when(draw < bound, n).otherwise(weight)
    return weight


def _draws() -> list[Column]:
    """The draws of a hash, as two words ``_w0`` and ``_w1``."""
    return [F.shiftright(w, DRAW_BITS * j).bitwiseAND(F.lit(2**DRAW_BITS - 1)) for w in ("_w0", "_w1") for j in range(DRAWS // 2)]


def replicate_counts(
    df: DataFrame,
    key: str | Sequence[str],
    replicates: int = 200,
    seed: int = SEED,
    truth: str = "truth",
    prediction: str = "prediction",
    by: Sequence[str] = (),
) -> DataFrame:
    """``[by,] replicate, truth, prediction, n``; replicate -1 is the table itself. ``key`` must identify a row.

    A row is hashed once for every 8 replicates, and its weights go straight into the counts of its task."""
    key = [key] if isinstance(key, str) else list(key)
    blocks = F.sequence(F.lit(0), F.lit(-(-replicates // DRAWS) - 1))
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"_k{i}") for i, k in enumerate(key)]
    rows = df.select(*by, F.col(truth).alias("truth"), F.col(prediction).alias("prediction"), *parts, F.explode(blocks).alias("_block"))
    name = F.concat(F.lit(f"{seed}:bootstrap"), F.col("_block").cast("string"))
    hashed = F.md5(F.concat_ws(":", name, *[f"_k{i}" for i in range(len(key))]))
    words = [F.conv(F.substring(hashed, at, 15), 16, 10).cast("long").alias(f"_w{i}") for i, at in enumerate((1, 16))]
    kept = [*by, "truth", "prediction"]
    drawn = [F.struct((F.col("_block") * DRAWS + j).alias("replicate"), poisson(d).alias("_n")) for j, d in enumerate(_draws())]
    itself = F.struct(F.lit(-1).alias("replicate"), F.when(F.col("_block") == 0, 1).otherwise(0).alias("_n"))
    counted = rows.select(*kept, "_block", *words).select(*kept, F.inline(F.array(itself, *drawn)))
    return counted.filter((F.col("_n") > 0) & (F.col("replicate") < replicates)).groupBy(*by, "replicate", "truth", "prediction").agg(F.sum("_n").alias("n"))


def _interval(level: float) -> list[float]:
    return [round((1 - level) / 2, 9), round((1 + level) / 2, 9)]


def _lines(tidy: DataFrame, by: Sequence[str], level: float) -> DataFrame:
    drawn = F.when(F.col("replicate") >= 0, F.col("value"))
    found = tidy.groupBy(*by, "metric").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("value"), F.percentile(drawn, _interval(level)).alias("_ends")
    )
    return found.select(*by, "metric", "value", F.get("_ends", F.lit(0)).alias("low"), F.get("_ends", F.lit(1)).alias("high"))


def _tidy(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return macro_metrics(counts, by=(*by, "replicate")).unpivot([*by, "replicate"], list(METRICS), "metric", "value")


def intervals(counts: DataFrame, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """``[by,] metric, value, low, high`` of replicate_counts(): the figure of the table and the interval that ``level`` of the replicates lie in."""
    return _lines(_tidy(counts, by), by, level)


def difference_intervals(counts: DataFrame, by: str, first, second, level: float = 0.95) -> DataFrame:
    """``metric, value, low, high, differs`` of the first run's figure less the second's, replicate by replicate.

    Runs that scored the same keys drew the same rows, so what both find hard cancels out. ``differs`` says that 0 lies outside."""
    tidy = _tidy(counts.filter(F.col(by).isin(first, second)), (by,))
    sign = F.when(F.col(by) == F.lit(first), F.col("value")).otherwise(-F.col("value"))
    apart = tidy.groupBy("replicate", "metric").agg(F.sum(sign).alias("value"))
    return _lines(apart, (), level).withColumn("differs", (F.col("low") > 0) | (F.col("high") < 0))
