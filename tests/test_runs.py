import json

import pytest

from ticketflow.operators import metrics, runs, score
from ticketflow.sources import runs as files


@pytest.mark.parametrize(
    "f1, stop, best",
    [
        ([1, 1, 1, 1, 1], 3, 1),
        ([0.5, 0.6, 0.6, 0.7, 0.6], 5, 4),
        ([0.9, 0.8, 0.7, 0.95, 1], 3, 1),
        ([0.4], 1, 1),
    ],
)
def test_early_stop_and_best_round(spark, f1, stop, best):
    rows = [("r", i + 1, float(v)) for i, v in enumerate(f1)]
    history = spark.createDataFrame(rows, "run_id string, epoch int, f1_macro double")
    assert runs.early_stop(history).first().stop_epoch == stop
    row = runs.best_round(history).first()
    assert (row.stop_epoch, row.best_epoch, row.f1_macro) == (stop, best, float(f1[best - 1]))


PUBLISHED = {
    "full": dict(training_time_seconds=38.96, peak_gpu_memory_mb=2341.16, weighted=True),
    "compact": dict(
        training_time_seconds=113.8114241000003,
        peak_gpu_memory_mb=1741.60400390625,
        total_parameters=112170252,
        trainable_parameters=2683398,
        weighted=False,
    ),
}


def published(spark, method):
    perfect = dict(accuracy=1.0, f1_macro=1.0, precision_macro=1.0, recall_macro=1.0, seed=42)
    return runs.run_record(spark, model="base", method=method, **perfect, **PUBLISHED[method])


def test_compare_and_choose(spark, tmp_path):
    path = str(tmp_path / "runs")
    for method in PUBLISHED:
        files.append_run(published(spark, method), path)
    table = files.read_runs(spark, path)
    assert table.count() == 2
    rows = {r.metric: (r.full, r.compact) for r in runs.compare_runs(table, ["full", "compact"]).collect()}
    assert rows["f1_macro"] == (1.0, 1.0)
    assert rows["training_time_seconds"] == (38.96, 113.8114241000003)
    assert rows["trainable_percentage"] == (None, pytest.approx(2.3922545881416046))
    assert runs.choose_run(table).first().method == "full"


def test_reads_an_indented_record(spark, tmp_path):
    record = {"model": "m", "method": "x", "accuracy": 1.0, "total_parameters": 5, "seed": 42}
    (tmp_path / "run.json").write_text(json.dumps(record, indent=4))
    row = files.read_runs(spark, str(tmp_path / "run.json"), multi_line=True).first()
    assert (row.model, row.accuracy, row.total_parameters, row.f1_macro) == ("m", 1.0, 5, None)


def test_unknown_field(spark):
    with pytest.raises(ValueError):
        runs.run_record(spark, colour="red")


def test_savings(spark):
    df = spark.createDataFrame([(0.99,), (0.95,)], "confidence double")
    row = runs.roi(metrics.automation_summary(score.route(df))).first()
    assert tuple(row) == (1.0, 15000.0, 180000.0)
