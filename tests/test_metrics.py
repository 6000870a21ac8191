import math
import random

import pytest
from pyspark.sql import functions as F

from ticketflow.operators import metrics


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "truth string, prediction string")


def by_hand(pairs, labels=None):
    """Accuracy, macro F1, precision and recall, the long way."""
    labels = labels or sorted({x for p in pairs for x in p})
    sums = [0.0, 0.0, 0.0]
    for label in labels:
        tp = sum(t == p == label for t, p in pairs)
        predicted, support = sum(p == label for _, p in pairs), sum(t == label for t, _ in pairs)
        precision = tp / predicted if predicted else 0.0
        recall = tp / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        sums = [a + b for a, b in zip(sums, (f1, precision, recall))]
    return [sum(t == p for t, p in pairs) / len(pairs), *[s / len(labels) for s in sums]]


@pytest.mark.parametrize("seed", range(3))
def test_macro_against_long_way(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice("abcd"), rng.choice("bcde")) for _ in range(200)]
    counts = metrics.confusion(frame(spark, pairs))
    assert counts.agg(F.sum("n")).first()[0] == len(pairs)
    assert list(metrics.macro_metrics(counts).first()) == pytest.approx(by_hand(pairs))
    listed = list("abcdefg")
    assert list(metrics.macro_metrics(counts, listed).first()) == pytest.approx(by_hand(pairs, listed))
    report = {r.row: r for r in metrics.class_report(counts).collect()}
    assert set(report) == {*"abcde", "accuracy", "macro avg", "weighted avg"}
    acc, f1, precision, recall = by_hand(pairs)
    assert report["accuracy"].f1 == pytest.approx(acc) and report["accuracy"].support == 200
    assert report["macro avg"].f1 == pytest.approx(f1)
    assert report["weighted avg"].recall == pytest.approx(acc)


def test_undefined_classes_are_zero(spark):
    counts = metrics.confusion(frame(spark, [("0", "0"), ("1", "2")]))
    rows = {r.label: tuple(r)[1:5] for r in metrics.class_metrics(counts).collect()}
    assert rows == {"0": (1.0, 1.0, 1.0, 1), "1": (0.0, 0.0, 0.0, 1), "2": (0.0, 0.0, 0.0, 0)}
    full = metrics.class_metrics(counts, [str(i) for i in range(6)]).collect()
    assert len(full) == 6 and sum(r.f1 for r in full) == 1.0


def test_matrix_is_zero_filled_in_label_order(spark):
    counts = metrics.confusion(frame(spark, [("a", "a"), ("a", "b"), ("a", "b")]))
    matrix = metrics.confusion_matrix(counts, ["b", "a", "c"])
    assert matrix.columns == ["truth", "b", "a", "c"]
    assert sorted(tuple(r) for r in matrix.collect()) == [("a", 2, 1, 0), ("b", 0, 0, 0), ("c", 0, 0, 0)]


def test_null_counts_as_wrong(spark):
    counts = metrics.confusion(frame(spark, [("a", "a"), ("a", None), (None, "a"), (None, None)]))
    row = metrics.macro_metrics(counts).first()
    assert row.accuracy == 0.25 and row.precision_macro == 0.5 and row.recall_macro == 0.5
    assert metrics.accuracy(counts).first().accuracy == 0.25


def test_empty_tables(spark):
    counts = metrics.confusion(frame(spark, []))
    assert tuple(metrics.macro_metrics(counts).first()) == (None,) * 4
    assert tuple(metrics.error_summary(counts).first()) == (0, 0, 0, None)
    scored = spark.createDataFrame([], "decision string, confidence double")
    assert tuple(metrics.automation_summary(scored).first()) == (0, 0, 0, None, None)
    assert tuple(metrics.confidence_stats(scored).first()) == (None, None, None)


def test_weighted_log_loss(spark):
    rows = [([0.5, 0.5], 0), ([0.2, 0.8], 1), ([0.9, 0.1], 1), ([0.9, 0.1], None)]
    df = spark.createDataFrame(rows, "probs array<double>, truth int")
    weights = spark.createDataFrame([(0, 3.0), (1, 0.5)], "label_id int, weight double")
    got = metrics.weighted_log_loss(df, weights).first().log_loss
    terms = [(3.0, 0.5), (0.5, 0.8), (0.5, 0.1)]
    assert got == pytest.approx(sum(-w * math.log(p) for w, p in terms) / 4.0)
    sure = spark.createDataFrame([([0.0, 1.0], 0)], "probs array<double>, truth int")
    assert metrics.weighted_log_loss(sure, weights).first().log_loss == math.inf


def test_summary_and_stats(spark):
    rows = [("automatic", 0.9), ("automatic", 1.0), ("human_review", 0.5), ("human_review", float("nan"))]
    df = spark.createDataFrame(rows, "decision string, confidence double")
    assert tuple(metrics.automation_summary(df).first()) == (4, 2, 2, 50.0, 50.0)
    assert tuple(metrics.confidence_stats(df).first()) == (pytest.approx(0.8), 0.5, 1.0)


def test_the_ten_new_examples(spark):
    """Seven of ten right; the three errors with their published confidence."""
    from ticketflow.fixed_values import NEW_EXAMPLES

    wrong = {3: ("feature_request", 0.8881), 7: ("billing", 0.9765), 8: ("account", 0.9890)}
    rows = [(t, e, *wrong.get(i, (e, None))) for i, (t, e) in enumerate(NEW_EXAMPLES)]
    df = spark.createDataFrame(rows, "text string, truth string, prediction string, confidence double")
    counts = metrics.confusion(df)
    assert tuple(metrics.error_summary(counts).first()) == (10, 7, 3, 0.7)
    found = {(r.expected, r.predicted, r.confidence) for r in metrics.errors(df).collect()}
    assert found == {
        ("general", "feature_request", 0.8881),
        ("cancellation", "billing", 0.9765),
        ("technical", "account", 0.9890),
    }
    assert metrics.confident_errors(df, 0.97).count() == 2
    assert [r.n for r in metrics.confused_pairs(counts, 5).collect()] == [1, 1, 1]
    assert [r.status for r in metrics.flag_errors(df).collect()].count("OK") == 7


def test_named_metrics(spark):
    counts = metrics.confusion(frame(spark, [("a", "a"), ("a", "b")]))
    assert metrics.named_metrics(counts, {"cells": F.count("*"), "rows": F.sum("n")}).first().asDict() == {
        "cells": 2,
        "rows": 2,
    }


def test_scored_metrics(spark):
    """User functions of probabilities and labels; null labels and an empty table too."""
    rows = [("a", [0.7, 0.2, 0.1], 0), ("a", [0.1, 0.3, 0.6], 1), ("b", [0.5, 0.3, 0.2], 2), ("b", [0.5, 0.3, 0.2], None)]
    df = spark.createDataFrame(rows, "part string, probs array<double>, truth int")
    wanted = {"mean": lambda p, t: F.avg(F.get(p, t)), "known": lambda p, t: F.count(t)}
    assert metrics.scored_metrics(df, wanted).first().asDict() == {"mean": pytest.approx(0.4), "known": 3}
    by = {r.part: (r["mean"], r.known) for r in metrics.scored_metrics(df, wanted, by=["part"]).collect()}
    assert by == {"a": (pytest.approx(0.5), 2), "b": (pytest.approx(0.2), 1)}
    assert tuple(metrics.scored_metrics(df.limit(0), wanted).first()) == (None, 0)


def test_macro_reads_the_rows_once(tickets):
    scored = tickets.select(F.col("category").alias("truth"), F.lower("category").alias("prediction"))
    for result in (metrics.macro_metrics, metrics.class_report):
        plan = result(metrics.confusion(scored))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1


def test_missing_sides_are_confused_pairs(spark):
    rows = [("a", "a", 5), ("a", None, 4), (None, "a", 3), (None, None, 2), ("a", "b", 1)]
    pairs = spark.createDataFrame(rows, "truth string, prediction string, n long")
    got = [tuple(r) for r in metrics.confused_pairs(pairs).collect()]
    assert got == [("a", None, 4), (None, "a", 3), (None, None, 2), ("a", "b", 1)]


def test_a_label_without_weight_is_an_error(spark):
    df = spark.createDataFrame([([0.5, 0.5], 0), ([0.5, 0.5], 1), ([0.5, 0.5], None)], "probs array<double>, truth int")
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0)], "label_id int, weight double")
    assert metrics.weighted_log_loss(df, weights).first().log_loss == pytest.approx(0.693147, abs=1e-6)
    with pytest.raises(Exception, match="no weight"):
        metrics.weighted_log_loss(df, weights.limit(1)).collect()
