"""The whole job in steps that hand over by tables in one folder:
prepare, train, automate, errors, predict, compare."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.fixed_values import LABELS, SEED
from ticketflow.operators import calibrate, fit, labels, metrics, runs, score, synth, thresholds
from ticketflow.operators.split import TEST, TRAIN, VALIDATION
from ticketflow.plans.training import evaluated, store_splits
from ticketflow.schema import TICKET
from ticketflow.sources import runs as run_files
from ticketflow.sources import tickets as files

METHODS = {"full": fit.FitConfig(), "compact": fit.FitConfig(components=fit.COMPONENTS)}


def prepare(spark: SparkSession, folder: str, scale: int = 1, seed: int = SEED) -> DataFrame:
    """Generate and store the ticket table and its splits; returns the split
    table as stored."""
    files.write_tickets(synth.synthesize_tickets(spark, seed, scale), f"{folder}/tickets")
    tickets = files.read_tickets(spark, f"{folder}/tickets", "parquet")
    store_splits(tickets, f"{folder}/splits", seed=seed)
    return spark.read.parquet(f"{folder}/splits")


def prepare_from(df: DataFrame, folder: str, seed: int = SEED, csv: bool = False) -> DataFrame:
    """The same for a ticket table that exists; ``csv`` stores the splits as
    CSV, too."""
    store_splits(df.select(*TICKET.names), f"{folder}/splits", seed=seed)
    stored = df.sparkSession.read.parquet(f"{folder}/splits")
    if csv:
        files.write_splits(stored, f"{folder}/splits_csv", "csv")
    return stored


def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """F1 of each class, by method, from the stored class reports."""
    reports = spark.read.parquet(f"{folder}/reports/classes").filter(F.col("row").isin(*LABELS))
    return reports.groupBy("row").pivot("method", list(METHODS)).agg(F.first("f1")).orderBy("row")


def train(spark: SparkSession, folder: str, method: str = "full", seed: int = SEED) -> DataFrame:
    """Fit on the stored splits; store the model, its history, its calibration and
    threshold curve from the validation rows, and class report
    and confusion matrix of the test rows; append and return its run record. The full fit is class-weighted, the compact one is not."""
    parts = {name: files.read_split(spark, f"{folder}/splits", name) for name in (TRAIN, VALIDATION, TEST)}
    cfg = replace(METHODS[method], seed=seed)
    if method == "full":
        result = fit.fit_full(parts[TRAIN], parts[VALIDATION], labels.class_weights(parts[TRAIN]), cfg)
    else:
        result = fit.fit_compact(parts[TRAIN], parts[VALIDATION], cfg)
    run_files.save_model(result.model, f"{folder}/models/{method}")
    held = score.score(result.model, parts[VALIDATION]).withColumnRenamed("category", "truth")
    calibration = calibrate.fit_calibration(held)
    run_files.save_model(calibration, f"{folder}/calibrations/{method}")
    curve = thresholds.threshold_curve(calibrate.calibrated(calibration, held), inclusive=True)
    curve.write.mode("overwrite").parquet(f"{folder}/thresholds/method={method}")
    result.history_frame(spark, method).write.mode("overwrite").parquet(f"{folder}/history/{method}")
    pairs = metrics.confusion(score.score(result.model, parts[TEST]).withColumnRenamed("category", "truth"))
    reports = {"classes": metrics.class_report(pairs), "confusion": metrics.confusion_matrix(pairs, LABELS)}
    for name, report in reports.items():
        report.write.mode("overwrite").parquet(f"{folder}/reports/{name}/method={method}")
    record = evaluated(result, parts[TEST], "hashed tokens", method)
    run_files.append_run(record, f"{folder}/runs")
    return record


def automate(
    spark: SparkSession, folder: str, method: str = "full", csv: bool = False, precision: float | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Score the stored test split and store the rows by decision, also as one
    CSV table if asked for; returns
    automation summary, confidence statistics and savings.

    With a ``precision`` the confidence is calibrated and what reaches the smallest threshold that kept it on the validation rows is automatic
    (ValueError if none did); else the fixed threshold decides on the model's own confidence."""
    test = files.read_split(spark, f"{folder}/splits", TEST)
    model = run_files.load_model(f"{folder}/models/{method}")
    if precision is None:
        scored = score.score(model, test)
    else:
        curve = spark.read.parquet(f"{folder}/thresholds").filter(F.col("method") == method).drop("method")
        best = thresholds.choose_threshold(curve, precision).first().threshold
        if best is None:
            raise ValueError(f"no threshold has a precision of {precision} on the validation rows")
        calibration = run_files.load_calibration(f"{folder}/calibrations/{method}")
        scored = score.score(model, test, threshold=best, inclusive=True, calibration=calibration).drop(calibrate.RAW)
    files.write_routed(scored, f"{folder}/scored")
    if csv:
        files.write_scored(scored, f"{folder}/scored_csv")
    stored = spark.read.parquet(f"{folder}/scored")
    summary = metrics.automation_summary(stored)
    return summary, metrics.confidence_stats(stored), runs.roi(summary)


def new_examples(spark: SparkSession, folder: str, method: str = "full") -> tuple[DataFrame, DataFrame]:
    """Error summary and all inline examples, each OK or ERROR."""
    model = run_files.load_model(f"{folder}/models/{method}")
    scored = score.score(model, files.inline_examples(spark)).withColumnRenamed("expected", "truth")
    rows = metrics.flag_errors(scored).select("text", "truth", "prediction", "confidence", "status")
    return metrics.error_summary(metrics.confusion(scored)), rows


def predict(spark: SparkSession, folder: str, texts: list[str], method: str = "full") -> DataFrame:
    """Prediction records of single texts; at the threshold counts as above."""
    model = run_files.load_model(f"{folder}/models/{method}")
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return score.prediction_record(score.score(model, rows, inclusive=True))


def compare(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All stored runs side by side, and the one to use."""
    table = run_files.read_runs(spark, f"{folder}/runs")
    return runs.compare_runs(table, list(METHODS)), runs.choose_run(table)
