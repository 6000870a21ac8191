import math

import pytest

from ticketflow.functions import scores
from ticketflow.operators import score


def test_threshold_rules(spark):
    values = [0.79999, 0.8, 0.80001, 0.80004, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "confidence double")
    a, h = "automatic", "human_review"
    assert [r.decision for r in score.route(df).collect()] == [h, h, a, a, h, h]
    assert [r.decision for r in score.route(df, inclusive=True).collect()] == [h, a, a, a, h, h]


def test_routing_comes_before_rounding(spark):
    df = spark.createDataFrame([(0.80004,)], "confidence double")
    row = score.round_out(score.route(df)).first()
    assert (row.confidence, row.decision) == (0.8, "automatic")


@pytest.mark.parametrize(
    "probs, expected", [([0.4, 0.4, 0.2], 0), ([1 / 3] * 3, 0), ([0.1, 0.2, 0.7], 2), ([0.2, 0.4, 0.4], 1)]
)
def test_ties_go_to_the_lowest(spark, probs, expected):
    df = spark.createDataFrame([(probs,)], "probs array<double>")
    row = score.decide(df, ["a", "b", "c"]).first()
    assert row.prediction == "abc"[expected] and row.confidence == max(probs)


def test_softmax(spark):
    logits = [[1.0, 2.0, 3.0], [1000.0, 1000.0, -1000.0], [-5.0, 0.0, 5.0]]
    df = spark.createDataFrame([(z,) for z in logits], "z array<double>")
    rows = df.select("z", scores.softmax("z").alias("p"), scores.max_probability("z").alias("m")).collect()
    for r in rows:
        e = [math.exp(x - max(r.z)) for x in r.z]
        assert r.p == pytest.approx([x / sum(e) for x in e])
        assert sum(r.p) == pytest.approx(1) and r.m == pytest.approx(max(r.p))


def test_decode_outside_the_list(spark):
    df = spark.createDataFrame([(0,), (2,), (None,)], "i int")
    assert [r.c for r in df.select(scores.decode("i", ["x", "y"]).alias("c")).collect()] == ["x", None, None]
