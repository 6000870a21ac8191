"""Evaluation of predictions. Everything but the confidence figures comes from
one table of (truth, prediction) counts: rows are combined before the shuffle
and never travel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.fixed_values import AUTOMATIC, ERROR, HUMAN_REVIEW, OK
from ticketflow.schema import MAX_INLINE_ROWS

Labels = str | Sequence


def _ratio(part: Column, whole: Column) -> Column:
    """0.0 where the denominator is 0, as for a class nobody predicted."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def confusion(df: DataFrame, truth: str = "truth", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """``[by,] truth, prediction, n`` for the pairs that occur."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(pairs: DataFrame, labels: Sequence) -> DataFrame:
    """Rows are truth, one column per predicted label, 0 where nothing fell.

    ``labels`` gives the rows and the columns; ``pairs`` comes from confusion().
    """
    if len(labels) > MAX_INLINE_ROWS:
        raise ValueError("too many labels for a matrix")
    cell = [
        F.coalesce(F.sum(F.when(F.col("prediction") == F.lit(v), F.col("n"))), F.lit(0)).alias(str(v)) for v in labels
    ]
    every = pairs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in labels])).alias("truth"))
    return every.join(pairs, "truth", "left").groupBy("truth").agg(*cell)


def _class_totals(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``[by,] label, support, predicted, tp`` with one aggregate: each pair
    adds to the label of its truth and to that of its prediction. What has no
    truth or no prediction is kept under a null label."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
    as_truth = F.struct(
        F.col("truth").alias("label"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")
    )
    as_prediction = F.struct(
        F.col("prediction").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")
    )
    return (
        pairs.select(*by, F.inline(F.array(as_truth, as_prediction)))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )


def _scores() -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of a row of class totals."""
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return _ratio(tp, predicted), _ratio(tp, support), _ratio(2 * tp, support + predicted)


def class_metrics(pairs: DataFrame, labels: Labels = "present") -> DataFrame:
    """``label, precision, recall, f1, support, tp`` per class.

    ``labels="present"`` covers the classes found in truth or prediction; a
    list covers exactly that list, zero-filled. Null is no class.
    """
    totals = _class_totals(pairs).filter("label is not null")
    if not isinstance(labels, str):
        listed = F.explode(F.array(*[F.lit(v) for v in labels])).alias("label")
        totals = (
            pairs.sparkSession.range(1)
            .select(listed)
            .join(totals, "label", "left")
            .fillna(0, ["support", "predicted", "tp"])
        )
    precision, recall, f1 = _scores()
    return totals.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "tp")


def accuracy(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``[by,] accuracy``; null on either side counts as wrong."""
    right = F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0))
    grouped = pairs.groupBy(*by) if by else pairs.groupBy()
    return grouped.agg(F.try_divide(right, F.sum("n")).alias("accuracy"))


def macro_metrics(pairs: DataFrame, labels: Labels = "present", by: Sequence[str] = ()) -> DataFrame:
    """``[by,] accuracy, f1_macro, precision_macro, recall_macro``.

    Accuracy is over all rows. A listed label that does not occur counts as
    0.0, so the list only changes what the sums are divided by.
    """
    if isinstance(labels, str):
        counted, size = F.col("label").isNotNull(), F.count("label")
    else:
        counted, size = F.col("label").isin(*labels), F.lit(len(labels))
    totals = _class_totals(pairs, by)
    precision, recall, f1 = _scores()
    mean = lambda part: F.try_divide(F.sum(F.when(counted, part)), size)
    grouped = totals.groupBy(*by) if by else totals.groupBy()
    return grouped.agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        mean(f1).alias("f1_macro"),
        mean(precision).alias("precision_macro"),
        mean(recall).alias("recall_macro"),
    )


def class_report(pairs: DataFrame, labels: Labels = "present") -> DataFrame:
    """``row, precision, recall, f1, support``: the classes, then accuracy (in
    the f1 column), macro avg and support-weighted avg.

    One rollup over the class rows gives each of them and the total that the averages come from, so
    no task holds all classes and the predictions are read once.
    """
    parts = ("precision", "recall", "f1")
    null, n = F.lit(None).cast("double"), F.col("support")
    sums = [F.sum(c).alias(c) for c in ("support", "tp")]
    means = [F.avg(c).alias(c) for c in parts]
    weighted = [_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"_{c}") for c in parts]
    rolled = class_metrics(pairs, labels).rollup("label").agg(F.grouping("label").alias("_total"), *sums, *means, *weighted)

    def line(name, precision, recall, f1):
        values = zip(("row", *parts, "support"), (name, precision, recall, f1, n))
        return F.struct(*[v.alias(k) for k, v in values])

    own = [F.col(c) for c in parts]
    overall = F.when(n.isNotNull(), _ratio(F.col("tp"), n))
    totals = [
        line(F.lit("accuracy"), null, null, overall),
        line(F.lit("macro avg"), *own),
        line(F.lit("weighted avg"), *[F.col(f"_{c}") for c in parts]),
    ]
    lines = F.when(F.col("_total") == 1, F.array(*totals)).otherwise(F.array(line(F.col("label").cast("string"), *own)))
    return rolled.select(F.inline(lines))


def named_metrics(pairs: DataFrame, expressions: dict[str, Column]) -> DataFrame:
    """User-defined figures: named aggregates over ``truth, prediction, n``."""
    return pairs.agg(*[e.alias(name) for name, e in expressions.items()])


def scored_metrics(
    df: DataFrame,
    functions: dict[str, Callable[[Column, Column], Column]],
    probs: str = "probs",
    truth: str = "truth",
    by: Sequence[str] = (),
) -> DataFrame:
    """``[by,]`` user-defined figures of scored rows: each function takes the array of probabilities (or logits) and the label id
    and returns an aggregate. All of them read the rows once. A fit takes the same functions and gives them for every round.
    """
    figures = [f(F.col(probs), F.col(truth)).alias(name) for name, f in functions.items()]
    return (df.groupBy(*by) if by else df).agg(*figures)


def weighted_log_loss(
    df: DataFrame, weights: DataFrame, probs: str = "probs", truth: str = "truth", name: str = "log_loss"
) -> DataFrame:
    """Sum(w * -ln p(truth)) / Sum(w) over the rows with a known truth.

    ``truth`` is a label id; ``weights`` has one row per label. A truth without
    a weight is an error.
    """
    p = F.get(F.col(probs), F.col(truth))
    loss = F.when(p == 0, F.lit(float("inf"))).otherwise(-F.ln(p))
    per_class = weights.select(F.col("label_id").alias(truth), "weight")
    missing = F.raise_error(F.concat(F.lit("no weight for label "), F.col(truth).cast("string"))).cast("double")
    return (
        df.select(truth, loss.alias("_loss"))
        .filter(F.col(truth).isNotNull())
        .join(per_class, truth, "left")
        .withColumn("weight", F.coalesce("weight", missing))
        .agg(F.try_divide(F.sum(F.col("weight") * F.col("_loss")), F.sum("weight")).alias(name))
    )


def automation_summary(
    df: DataFrame, decision: str = "decision", by: Sequence[str] = (), rows: str | None = None
) -> DataFrame:
    """``[by,] total, automatic, human_review`` and both percentages (null for
    an empty table). ``rows`` names a count column if lines stand for several
    rows."""
    n = F.col(rows) if rows else F.lit(1).cast("long")
    d = F.col(decision)
    grouped = df.groupBy(*by) if by else df.groupBy()
    counts = grouped.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(d == AUTOMATIC, n)), F.lit(0)).alias("automatic"),
        F.coalesce(F.sum(F.when(d == HUMAN_REVIEW, n)), F.lit(0)).alias("human_review"),
    )
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("total"))
    return counts.withColumn("automatic_pct", share("automatic")).withColumn("human_review_pct", share("human_review"))


def confidence_stats(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Mean, minimum and maximum of the known confidences."""
    c = F.col(confidence)
    known = F.when(~F.isnan(c), c)
    return df.agg(
        F.avg(known).alias("mean_confidence"),
        F.min(known).alias("min_confidence"),
        F.max(known).alias("max_confidence"),
    )


def flag_errors(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Add ``status``: OK where both agree, else ERROR."""
    return df.withColumn("status", F.when(F.col(truth) == F.col(prediction), OK).otherwise(ERROR))


def errors(df: DataFrame, keep: Sequence[str] = ("text",), truth: str = "truth", prediction: str = "prediction"):
    """The wrong rows as ``keep..., expected, predicted, confidence``."""
    wrong = flag_errors(df, truth, prediction).filter(F.col("status") == ERROR)
    return wrong.select(
        *keep, F.col(truth).alias("expected"), F.col(prediction).alias("predicted"), "confidence"
    )


def error_summary(pairs: DataFrame) -> DataFrame:
    """One row: evaluated, correct, errors, accuracy."""
    right = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
    sums = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"), F.coalesce(F.sum(right), F.lit(0)).alias("correct")
    )
    return sums.select(
        "evaluated",
        "correct",
        (F.col("evaluated") - F.col("correct")).alias("errors"),
        F.try_divide("correct", "evaluated").alias("accuracy"),
    )


def confused_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent (truth, wrong prediction) pairs; a missing side is
    wrong, as in flag_errors()."""
    wrong = pairs.filter(~F.coalesce(F.col("truth") == F.col("prediction"), F.lit(False)))
    return wrong.orderBy(F.desc("n"), "truth", "prediction").limit(k)


def confident_errors(
    df: DataFrame,
    threshold: float = 0.97,
    keep: Sequence[str] = ("text",),
    truth: str = "truth",
    prediction: str = "prediction",
) -> DataFrame:
    """Wrong rows whose confidence is above ``threshold``."""
    c = F.col("confidence")
    return errors(df, keep, truth, prediction).filter(~F.isnan(c) & (c > threshold))
