import pytest

from ticketflow.plans import steps
from ticketflow.sources import tickets as files


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("job"))
    assert steps.prepare(spark, path).count() == 5000
    for method in steps.METHODS:
        steps.train(spark, path, method)
    return path


def test_automation(spark, folder):
    summary, stats, savings = (df.first() for df in steps.automate(spark, folder))
    """As published: all 750 test tickets are automated, at full savings."""
    assert (summary.total, summary.automatic, summary.human_review) == (750, 750, 0)
    assert 0.9 < stats.min_confidence <= stats.mean_confidence <= stats.max_confidence <= 1
    assert (savings.monthly_saving, savings.annual_saving) == (15000.0, 180000.0)


def test_automation_at_a_wanted_precision(spark, folder):
    summary, stats, _ = (df.first() for df in steps.automate(spark, folder, precision=0.95))
    assert summary.total == 750 and summary.automatic + summary.human_review == 750
    assert 0 <= stats.min_confidence <= stats.max_confidence <= 1
    with pytest.raises(ValueError, match="precision"):
        steps.automate(spark, folder, precision=1.5)


def test_examples_and_predictions(spark, folder):
    summary, wrong = steps.new_examples(spark, folder)
    rows = wrong.collect()
    assert len(rows) == 10 and {r.status for r in rows} <= {"OK", "ERROR"}
    assert summary.first().correct >= 7 and summary.first().errors == sum(r.status == "ERROR" for r in rows)
    assert steps.predict(spark, folder, ["I want to cancel my subscription."]).first().category == "cancellation"


def test_compare(spark, folder):
    table, chosen = steps.compare(spark, folder)
    rows = {r.metric: r for r in table.collect()}
    assert rows["f1_macro"]["full"] == 1.0
    assert rows["trainable_percentage"]["compact"] < rows["trainable_percentage"]["full"]
    assert chosen.first().method in steps.METHODS
    classes = steps.class_scores(spark, folder).collect()
    assert len(classes) == 6 and all(r.full == 1.0 and r.compact > 0.9 for r in classes)
    for method in steps.METHODS:
        assert spark.read.parquet(f"{folder}/history/{method}").count() >= 1
        cells = spark.read.parquet(f"{folder}/reports/confusion/method={method}").drop("truth").collect()
        assert sum(sum(r) for r in cells) == 750


def test_existing_table(spark, tickets, tmp_path):
    assert steps.prepare_from(tickets, str(tmp_path / "j")).count() == 5000


def test_tables_as_csv(spark, folder, tickets, tmp_path):
    path = str(tmp_path / "j")
    steps.prepare_from(tickets, path, csv=True)
    assert files.read_split(spark, f"{path}/splits_csv", "test", "csv").count() == 750
    steps.automate(spark, folder, csv=True)
    assert spark.read.option("header", True).csv(f"{folder}/scored_csv").count() == 750


def test_a_file_without_line_breaks_is_read_in_parts(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(200_000).selectExpr("id", "repeat('text ', 20) AS text", "'billing' AS category", "1 AS annotator_confidence").coalesce(1).write.option("header", True).csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        assert files.read_tickets(spark, path, multi_line=False).rdd.getNumPartitions() > 3
        assert files.read_tickets(spark, path).rdd.getNumPartitions() == 1
        assert files.read_tickets(spark, path, multi_line=False).count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
