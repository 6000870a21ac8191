"""Labels that are probably wrong, by confident learning over out-of-fold probabilities.

No row is judged by a model that saw it or its copies: folds go by a hash of the normalised text. A class's threshold is
the mean probability that rows with its label have for it; a row is confidently of the likeliest class whose threshold it reaches, and
suspect if that is not its label.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.fixed_values import SEED
from ticketflow.functions.draws import draw
from ticketflow.operators import fit, score
from ticketflow.operators.audits import text_key

FOLDS = 3


def with_fold(df: DataFrame, folds: int = FOLDS, text: str = "text", seed: int = SEED) -> DataFrame:
    """df with ``_fold``; rows of equal normalised text share one."""
    return df.withColumn("_fold", F.floor(draw(seed, "fold", text_key(text)) * folds).cast("int"))


def out_of_fold(
    df: DataFrame, cfg: fit.FitConfig, folds: int = FOLDS, text: str = "text", category: str = "category"
) -> DataFrame:
    """df with ``probs``, each row's by a fit on the other folds. One fit per fold; df is read that often, so store what it is
    made of before."""
    if folds < 2:
        raise ValueError("at least two folds")
    parts = with_fold(df, folds, text, cfg.seed)
    scored = []
    for k in range(folds):
        model = fit.fit_full(parts.filter(F.col("_fold") != k), None, None, cfg, text, category).model
        scored.append(score.with_probabilities(model, parts.filter(F.col("_fold") == k).drop("_fold"), text))
    return reduce(DataFrame.unionByName, scored)


def class_thresholds(scored: DataFrame, labels: Sequence[str], category: str = "category", probs: str = "probs") -> DataFrame:
    """One row, one array: for each label the mean probability that the rows carrying it have for it; null without such rows."""
    own = [F.avg(F.when(F.col(category) == F.lit(v), F.get(probs, F.lit(i)))) for i, v in enumerate(labels)]
    return scored.agg(F.array(*own).alias("_thresholds"))


def _confident(probs: str, labels: Sequence[str]) -> Column:
    reached = [
        F.when(F.get(probs, F.lit(i)) >= F.get("_thresholds", F.lit(i)), F.struct(F.get(probs, F.lit(i)).alias("p"), F.lit(-i).alias("i"), F.lit(v).alias("v")))
        for i, v in enumerate(labels)
    ]
    return F.greatest(*reached)["v"] if len(reached) > 1 else reached[0]["v"]


def judged(scored: DataFrame, labels: Sequence[str], category: str = "category", probs: str = "probs") -> DataFrame:
    """scored with ``confident`` (a label, null if no threshold is reached), ``margin`` (its probability less that of the row's own
    label) and ``suspect``. Rows without a known label are never suspect."""
    known = scored.withColumn("_thresholds", class_thresholds(scored, labels, category, probs).scalar())
    found = known.withColumn("confident", _confident(probs, labels)).drop("_thresholds")
    at = lambda c: reduce(lambda rest, iv: F.when(F.col(c) == F.lit(iv[1]), F.get(probs, F.lit(iv[0]))).otherwise(rest), enumerate(labels), F.lit(None).cast("double"))
    other = F.col(category).isin(*labels) & (F.col("confident") != F.col(category))
    return found.withColumn("margin", at("confident") - at(category)).withColumn("suspect", F.coalesce(other, F.lit(False)))


def confident_joint(found: DataFrame, category: str = "category") -> DataFrame:
    """``label, confident, n``: how many rows of each label are confidently of which class; off the diagonal are the suspects."""
    counted = found.filter(F.col("confident").isNotNull() & F.col(category).isNotNull())
    return counted.groupBy(F.col(category).alias("label"), "confident").agg(F.count("*").alias("n"))
