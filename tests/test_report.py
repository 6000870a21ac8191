import pytest

from ticketflow.operators import audits, metrics


def test_report_of_many_classes_gathers_none(spark):
    pairs = spark.range(100_000).selectExpr("concat('c', id) AS truth", "if(id % 4 = 0, 'c0', concat('c', id)) AS prediction", "1L AS n")
    report = metrics.class_report(pairs)
    assert "collect" not in report._jdf.queryExecution().optimizedPlan().toString().lower()
    assert report.count() == 100_003
    rows = {r.row: r for r in report.filter("row in ('accuracy', 'macro avg', 'weighted avg', 'c1', 'c4')").collect()}
    assert rows["accuracy"].f1 == pytest.approx(75_001 / 100_000) and rows["macro avg"].support == 100_000
    assert rows["c1"].f1 == 1 and rows["c4"].f1 == 0 and rows["weighted avg"].recall == rows["accuracy"].f1


def test_contained_items_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "a b c d e f"), (2, "A, b"), (3, "..."), (4, None), (5, "a b c d e g"), (6, "f a b"), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "z A b c d e f"), (None, "a b c d e g!"), (None, "nothing"), (2, "b a"), (2, "x"), (3, ""), (4, None), (5, "a " * 5000 + "b c d e f a b")], "doc_id long, text string"
    )
    got = {tuple(r) for r in audits.contained_items(items, docs).collect()}
    assert got == {(1, 1), (2, 1), (5, None), (2, None), (None, 2), (1, 5), (2, 5), (6, 5)}
    assert audits.contained_items(items.filter("item_id = 3"), docs).count() == 0
    assert audits.contained_items(items, docs.filter("doc_id > 10")).count() == 0
