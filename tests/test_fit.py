import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ticketflow.fixed_values import LABELS
from ticketflow.operators import fit, labels, metrics, score
from ticketflow.plans import training
from ticketflow.sources import runs as run_files
from ticketflow.sources import tickets as files
from ticketflow.streaming import tickets as streams


@pytest.fixture(scope="module")
def full(splits):
    train, val, _ = splits
    return fit.fit_full(train, val, labels.class_weights(train), fit.FitConfig(features=4096))


def test_full_fit_on_the_standard_table(spark, splits, full):
    record = training.evaluated(full, splits[2], "hashed", "full").first()
    assert record.f1_macro == 1.0 and record.accuracy == 1.0
    assert record.weighted and record.seed == 42 and record.training_time_seconds > 0
    history = full.history_frame(spark).collect()
    best = max(r.f1_macro for r in history)
    assert history[full.best_epoch - 1].f1_macro == best
    assert all(r.f1_macro < best for r in history[: full.best_epoch - 1])
    assert len(history) in (5, full.best_epoch + 2)


def test_score_keeps_input_columns_and_whole_table(splits, full):
    test = splits[2]
    scored = score.score(full.model, test, keep_probs=True)
    assert scored.columns == [*test.columns, "probs", "prediction", "confidence", "decision"]
    rows = scored.collect()
    assert len(rows) == 750
    for r in rows:
        assert math.isclose(sum(r.probs), 1, abs_tol=1e-9) and r.confidence == max(r.probs)
        assert r.prediction == LABELS[r.probs.index(r.confidence)]
        assert r.decision == ("automatic" if r.confidence > 0.8 else "human_review")


def test_one_row_scores_like_many(spark, splits, full):
    rows = score.score(full.model, splits[2]).limit(3).collect()
    for r in rows:
        one = spark.createDataFrame([(r.text,)], "text string")
        assert score.score(full.model, one).first().confidence == pytest.approx(r.confidence)
    record = score.prediction_record(score.score(full.model, files.demo_texts(spark)))
    assert record.columns == ["text", "category", "confidence", "status"]
    assert record.count() == 6


def test_null_and_empty_text(spark, full):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    rows = score.score(full.model, df).collect()
    assert len(rows) == 2 and rows[0].prediction == rows[1].prediction


def test_empty_table(spark, full):
    empty = spark.createDataFrame([], "id long, text string, category string")
    scored = score.score(full.model, empty)
    assert scored.columns == ["id", "text", "category", "prediction", "confidence", "decision"]
    assert scored.count() == 0


def test_spread_rows_fit_the_same(splits, full):
    cfg = fit.FitConfig(features=4096, partitions=5, rounds=1)
    train, val, _ = splits
    again = fit.fit_full(train, val, labels.class_weights(train), cfg)
    assert again.history[0] == pytest.approx(full.history[0])


def test_name_clash(splits, full):
    with pytest.raises(ValueError):
        score.score(full.model, splits[2].withColumn("confidence", F.lit(1)))


def test_reload_and_stream(spark, splits, full, tmp_path):
    run_files.save_model(full.model, str(tmp_path / "model"))
    loaded = run_files.load_model(str(tmp_path / "model"))
    assert score.model_labels(loaded) == list(LABELS)
    batch = {r.id: r for r in score.score(full.model, splits[2]).collect()}
    again = {r.id: r for r in score.score(loaded, splits[2]).collect()}
    assert batch == again
    files.write_tickets(splits[2].repartition(3), str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    for _ in range(2):  # the second start finds nothing new
        query = streams.write_stream(
            streams.score_stream(loaded, stream), str(tmp_path / "out"), str(tmp_path / "ck"), partition_by=["decision"]
        )
        query.awaitTermination()
    streamed = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {i: (r.prediction, r.confidence, r.decision) for i, r in streamed.items()} == {
        i: (r.prediction, r.confidence, r.decision) for i, r in batch.items()
    }


def test_compact_fit(spark, splits):
    train, val, test = splits
    result = fit.fit_compact(train, val, fit.FitConfig(components=64))
    assert not result.weighted and result.params["trainable_parameters"] == 6 * 64 + 6
    assert result.params["trainable_percentage"] < 5
    figures = training.evaluated(result, test, "projected", "compact").first()
    assert figures.f1_macro > 0.8


def test_a_projection_needs_enough_features():
    for cfg in (fit.FitConfig(features=16, components=32), fit.FitConfig()):
        with pytest.raises(ValueError, match="features|components"):
            fit.fit_compact(None, cfg=cfg)


def test_a_projection_keeps_distances(spark):
    """It is linear, the same for one seed, and keeps lengths and distances up to a factor near 1."""
    cfg = fit.FitConfig(features=1024, components=256)
    vectors = [Vectors.sparse(1024, {7 * i % 1024: 1.0 + i % 3, (31 * i + 5) % 1024: -2.0}) for i in range(1, 40)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], ["id", "x"])
    for stage in fit.projection(cfg, "x", "y"):
        rows = stage.transform(rows)
    got = [r.y.toArray() for r in rows.orderBy("id").collect()]
    again = rows.select("id", "x")
    for stage in fit.projection(cfg, "x", "y"):
        again = stage.transform(again)
    assert all((r.y.toArray() == g).all() for r, g in zip(again.orderBy("id").collect(), got))
    ratios = []
    for i in range(len(vectors)):
        for j in range(i):
            true = ((vectors[i].toArray() - vectors[j].toArray()) ** 2).sum()
            ratios.append(((got[i] - got[j]) ** 2).sum() / true)
    assert 0.9 < sum(ratios) / len(ratios) < 1.1 and 0.5 < min(ratios) and max(ratios) < 1.6


def test_errors_on_new_examples(spark, full):
    scored = score.score(full.model, files.inline_examples(spark)).withColumnRenamed("expected", "truth")
    summary = metrics.error_summary(metrics.confusion(scored)).first()
    assert summary.evaluated == 10 and summary.correct >= 7
    assert metrics.errors(scored).count() == summary.errors


def test_token_limit_and_unknown_labels(spark):
    rows = [("a b zzz", "x"), ("b a zzz", "x"), ("c d zzz", "y"), ("d c zzz", "y"), ("q", "other"), ("q", None)] * 5
    df = spark.createDataFrame(rows, "text string, category string")
    cfg = fit.FitConfig(features=64, labels=["x", "y", "absent"], max_tokens=2)
    result = fit.fit_full(df, None, None, cfg)
    out = score.score(result.model, df.select("text"), keep_probs=True).collect()
    assert all(len(r.probs) == 3 for r in out)
    assert {(r.text[0] in "ab", r.prediction) for r in out if r.text != "q"} == {(True, "x"), (False, "y")}


def test_external_model(spark):
    def load():
        import numpy as np

        return lambda x: np.stack([x, -x], axis=1)

    df = spark.createDataFrame([(float(i),) for i in range(-50, 50)], "x double")
    rows = score.score_with(load, df, ["x"], ["up", "down"]).collect()
    assert len(rows) == 100
    for r in rows:
        assert r.prediction == ("up" if r.x >= 0 else "down")
        assert r.confidence == pytest.approx(1 / (1 + math.exp(-2 * abs(r.x))))


def test_user_figures_of_every_round(spark):
    rows = [(f"red apple {i}", "a") for i in range(30)] + [(f"blue plum {i}", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "text string, category string").repartition(4).cache()
    wanted = {"right": lambda p, t: F.avg((F.get(p, t) > 0.5).cast("int")), "sure": lambda p, t: F.avg(F.array_max(p))}
    cfg = fit.FitConfig(features=256, components=32, rounds=3, patience=5, labels=("a", "b"))
    for result in (fit.fit_full(df, df, None, cfg, functions=wanted), fit.fit_compact(df, df, cfg, functions=wanted)):
        history = result.history_frame(spark, "r").orderBy("epoch").collect()
        assert [r.epoch for r in history] == [1, 2, 3] and all(r.right == pytest.approx(r.accuracy) for r in history)
        # the last round's figure is that of the model on the same rows, by the same function
        last = fit.fit_full(df, None, None, cfg).model if result.params["trainable_parameters"] > 100 else None
        if last:
            scored = score.with_probabilities(last, df).withColumn("truth", (F.col("category") == "b").cast("int"))
            assert metrics.scored_metrics(scored, wanted).first().sure == pytest.approx(history[2].sure)
    plain = fit.fit_full(df, df, None, cfg).history_frame(spark)
    assert plain.schema.names == ["run_id", "epoch", "accuracy", "f1_macro", "precision_macro", "recall_macro"]
    df.unpersist()


def test_a_class_without_weight_is_an_error(spark):
    rows = spark.createDataFrame([("a b", "technical"), ("c d", "account")] * 3, "text string, category string")
    weights = spark.createDataFrame([("technical", 1.0)], "category string, weight double")
    with pytest.raises(Exception, match="no weight"):
        fit.fit_full(rows, None, weights, fit.FitConfig(features=64, rounds=1))
