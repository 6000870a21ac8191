import pytest

from ticketflow.fixed_values import LABELS
from ticketflow.operators import labels, profile


def test_weights_of_the_standard_train_split(splits):
    rows = labels.class_weights(splits[0]).collect()
    assert [r.category for r in rows] == list(LABELS)
    assert [round(r.weight, 4) for r in rows] == [0.5556, 0.6944, 0.9259, 1.1905, 1.8519, 3.3333]


def test_unknown_null_and_absent(spark):
    df = spark.createDataFrame([("a",), ("a",), ("other",), (None,)], "category string")
    rows = {r.category: (r.n, r.weight) for r in labels.class_weights(df, ["a", "b"]).collect()}
    assert rows == {"a": (2, 4 / (2 * 2)), "b": (None, None)}
    ids = [r.label_id for r in labels.encode_label(df, ["b", "a"]).orderBy("category").collect()]
    assert ids == [None, 1, 1, None]
    counts = profile.class_counts(df).collect()
    assert [tuple(r) for r in counts] == [("a", 2), ("other", 1)]


def test_decode_and_weight(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (None,)], "label_id int")
    got = {r.label_id: r.category for r in labels.decode_label(df, ["a", "b"]).collect()}
    assert got == {0: "a", 1: "b", 7: None, None: None}
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "category string")
    weighted = labels.with_weight(rows, labels.class_weights(rows, ["a", "b"]))
    assert sum(r.weight for r in weighted.collect()) == pytest.approx(3)


def test_only_text_and_label_reach_a_fit(tickets):
    assert profile.to_labelled(tickets).columns == ["text", "label"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "category string, split string")
    assert profile.class_counts(empty, pct=True).collect() == []
    assert profile.row_counts(empty).collect() == []
    assert [tuple(r) for r in labels.class_weights(empty, ["a"]).collect()] == [(0, "a", None, None)]
