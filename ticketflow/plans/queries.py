"""Every operator as a query over the driver tables: (spark, folder) -> DataFrame.

Doubles are rounded to six places, because their sums depend on row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.fixed_values import MAX_LENGTH, THRESHOLD
from ticketflow.functions import scores
from ticketflow.functions import text as tx
from ticketflow.functions.draws import draw, pick, weighted_choice
from ticketflow.operators import audits, bootstrap, calibrate, drift, encode, fit, labels, metrics, profile, runs, score, split, suspects, synth, thresholds
from ticketflow.plans import centroid, training
from ticketflow.plans.automation import automation_quality
from ticketflow.plans.tables import (
    EVENT_CLASSES,
    LANGUAGES,
    LINE_KEY,
    RETURN_FLAGS,
    decision_stream_columns,
    document_tickets,
    event_quotas,
    quality_pairs,
    scored_lines,
    table,
)
from ticketflow.schema import TICKET
from ticketflow.session import shared_folder
from ticketflow.sources import runs as run_files
from ticketflow.sources import tickets as files
from ticketflow.streaming import outcomes
from ticketflow.streaming import tickets as streams

FULL_FIT = fit.FitConfig(labels=LANGUAGES)
COMPACT_FIT = fit.FitConfig(components=fit.COMPONENTS, labels=LANGUAGES)
LEAST_F1 = 0.9


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    doubles = {c: F.round(c, places) for c, kind in df.dtypes if kind == "double"}
    return df.withColumns(doubles)


def joined(arr: str) -> F.Column:
    return F.array_join(F.col(arr).cast("array<string>"), " ")


# --- generated tables


def expand_quota(spark, d):
    return synth.expand_quota(event_quotas(spark, d))


def random_choices(spark, d):
    """A uniform and a weighted choice for every order."""
    orders = table(spark, d, "orders")
    values = F.array(*[F.lit(f"v{i}") for i in range(7)])
    return orders.select(
        "o_orderkey",
        pick(values, draw(7, "pick", "o_orderkey")).alias("picked"),
        weighted_choice((2, 3, 4, 5), (10, 25, 40, 25), draw(7, "weighted", "o_orderkey")).alias("weighted"),
    )


def generated_tickets(spark, d):
    return synth.tickets_from_quota(event_quotas(spark, d))


def shuffled_preview(spark, d):
    docs = synth.shuffle_rows(table(spark, d, "documents").select("doc_id", "lang"), key="doc_id")
    return profile.preview(docs, 5)


def shuffled_positions(spark, d):
    return synth.shuffle_rows(table(spark, d, "orders").select("o_orderkey"), key="o_orderkey")


# --- profiling and splitting


def class_counts(spark, d):
    return rounded(profile.class_counts(table(spark, d, "lineitem"), "l_returnflag", pct=True))


def class_counts_by_language(spark, d):
    return profile.class_counts(table(spark, d, "documents"), "lang")


def document_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return split.stratified_split(docs, "lang", key="doc_id")


def line_split_totals(spark, d):
    lines = table(spark, d, "lineitem").select(*LINE_KEY, "l_returnflag")
    cut = split.train_val_test_split(lines, "l_returnflag", key=LINE_KEY, labels=RETURN_FLAGS)
    return cut.groupBy("split", "l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("order_sum"), F.sum("l_partkey").alias("part_sum")
    )


def conversation_split(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return split.train_val_test_split(turns, "role", key=("conv_id", "turn"))


def _document_splits(spark, d):
    return split.train_val_test_split(document_tickets(spark, d), labels=LANGUAGES)


def counts_by_split(spark, d):
    return profile.class_counts_by_split(_document_splits(spark, d))


def split_row_counts(spark, d):
    return profile.row_counts(_document_splits(spark, d))


# --- labels and weights


def encoded_labels(spark, d):
    """Languages as ids; one language is not in the list and gets null."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"))
    return labels.encode_label(docs, LANGUAGES[:3])


def decoded_labels(spark, d):
    ids = table(spark, d, "embeddings").select("vec_id", (F.col("label") - 2).alias("label_id"))
    return labels.decode_label(ids, EVENT_CLASSES.values())


def labelled_projection(spark, d):
    rows = profile.to_labelled(document_tickets(spark, d), LANGUAGES)
    return rows.select(F.md5("text").alias("text_md5"), "label")


def class_weights(spark, d):
    """Train rows only; one listed class has no rows."""
    train = _document_splits(spark, d).filter("split = 'train'")
    return rounded(labels.class_weights(train, [*LANGUAGES, "it"]))


def row_weights(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "category")
    weighted = labels.with_weight(lines, labels.class_weights(lines, RETURN_FLAGS))
    return rounded(weighted.groupBy("category").agg(F.count("*").alias("n"), F.sum("weight").alias("weight_sum")))


# --- text encoding


def tokenized_documents(spark, d):
    docs = encode.tokenize(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(joined("tokens")).alias("tokens_md5"))


def fixed_length_tokens(spark, d):
    docs = encode.encode_fixed(table(spark, d, "documents").select("doc_id", "text"), max_length=MAX_LENGTH)
    return docs.select("doc_id", joined("tokens").alias("tokens"), joined("mask").alias("mask"))


def batch_padded_tokens(spark, d):
    turns = table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.nullif((F.col("conv_id").cast("long") / F.lit(8)).cast("long"), F.lit(0)).alias("batch_id"),
        tx.truncate(tx.tokens("text"), MAX_LENGTH).alias("tokens"),
    )
    padded = encode.pad_batch(turns)
    return padded.select("conv_id", "turn", F.size("tokens").alias("length"), joined("tokens").alias("tokens"), joined("mask").alias("mask"))


def vocabulary(spark, d):
    return encode.build_vocabulary(encode.tokenize(table(spark, d, "documents").select("text")))


def token_ids(spark, d):
    """Whole conversation turns encoded with the vocabulary of the documents."""
    turns = encode.tokenize(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    ids = encode.joined_token_ids(turns, vocabulary(spark, d), ["conv_id", "turn"])
    return ids.select("conv_id", "turn", joined("ids").alias("ids"))


def example_token_ids(spark, d):
    """The inline examples encoded with the vocabulary of the documents."""
    rows = encode.tokenize(files.inline_examples(spark))
    entries = encode.used_vocabulary(vocabulary(spark, d), rows)  # the whole grows with the documents
    return encode.token_ids(rows, entries).select("text", "expected", joined("ids").alias("ids"))


def mapped_batches(spark, d):
    """A user function over batches of the line items."""

    def net(batch):
        net = batch["l_extendedprice"] * (1 - batch["l_discount"])
        return batch[["l_orderkey", "l_linenumber"]].assign(net=net)

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return rounded(encode.map_batches(lines, net, "l_orderkey long, l_linenumber int, net double", batch_size=4096))


# --- scoring and routing


def _scored_embeddings(spark, d):
    scored = centroid.score_held_out(table(spark, d, "embeddings"))
    return score.route(scored)


def held_out_automation(spark, d):
    """Of the held-out rows, how many would be automated, and how right?"""
    return rounded(automation_quality(_scored_embeddings(spark, d)))


def held_out_predictions(spark, d):
    scored = _scored_embeddings(spark, d).select("vec_id", "split", "truth", "prediction", "confidence", "decision")
    return rounded(scored)


def softmax_rows(spark, d):
    """Softmax over the four numbers of a line item, one row per class."""
    lines = table(spark, d, "lineitem").select(
        *LINE_KEY,
        F.array((F.col("l_quantity") / 10), F.col("l_discount") * 50, F.col("l_tax") * 50).alias("logits"),
    )
    scored = lines.withColumn("probs", scores.softmax("logits")).withColumn("label_id", scores.argmax("probs"))
    return rounded(
        scored.groupBy("label_id").agg(
            F.count("*").alias("n"),
            F.avg(F.array_max("probs")).alias("confidence"),
            F.avg(scores.max_probability("logits")).alias("direct_confidence"),
            F.avg(F.get("probs", F.lit(0))).alias("p0"),
            F.avg(F.get("probs", F.lit(2))).alias("p2"),
        )
    )


def routed_lines(spark, d):
    """Both threshold rules over the same confidences, with nulls."""
    lines = table(spark, d, "lineitem").select(F.nullif(F.round(1 - F.col("l_discount") * 4, 2), F.lit(0.88)).alias("confidence"))
    strict, inclusive = scores.decision("confidence"), scores.decision("confidence", inclusive=True)
    return (
        lines.groupBy("confidence", strict.alias("decision"), inclusive.alias("inclusive_decision"))
        .agg(F.count("*").alias("n"))
    )


def rounded_confidence(spark, d):
    values = table(spark, d, "lineitem").select(*LINE_KEY, (F.col("l_extendedprice") / 104_729.0).alias("confidence"))
    return score.round_out(values)


# --- evaluation


def confusion(spark, d):
    return metrics.confusion(scored_lines(spark, d))


def confusion_matrix(spark, d):
    return metrics.confusion_matrix(metrics.confusion(scored_lines(spark, d)), [*RETURN_FLAGS, "X"])


def quality_accuracy(spark, d):
    return rounded(metrics.accuracy(metrics.confusion(quality_pairs(spark, d))))


def macro_metrics(spark, d):
    return rounded(metrics.macro_metrics(metrics.confusion(scored_lines(spark, d))))


def macro_metrics_listed(spark, d):
    """Over a fixed label list, one of which occurs nowhere."""
    pairs = metrics.confusion(scored_lines(spark, d))
    return rounded(metrics.macro_metrics(pairs, labels=[*RETURN_FLAGS, "Z"]))


def class_report(spark, d):
    return rounded(metrics.class_report(metrics.confusion(scored_lines(spark, d))))


def named_metrics(spark, d):
    right = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
    wanted = {"n_pairs": F.count("*"), "error_rate": 1 - F.sum(right) / F.sum("n"), "largest_cell": F.max("n")}
    return rounded(metrics.named_metrics(metrics.confusion(scored_lines(spark, d)), wanted))


def scored_metrics(spark, d):
    """User functions of probabilities and labels: two best, mean probability of the truth, squared error."""

    def squares(p, t):
        apart = F.transform(p, lambda x, i: F.pow(x - F.when(i == t, 1.0).otherwise(0.0), 2.0))
        return F.avg(F.aggregate(apart, F.lit(0.0), lambda a, x: a + x))

    wanted = {
        "top_2": lambda p, t: F.avg((F.size(F.filter(p, lambda x: x > F.get(p, t))) < 2).cast("double")),
        "p_truth": lambda p, t: F.avg(F.get(p, t)),
        "brier": squares,
    }
    return rounded(metrics.scored_metrics(centroid.score_held_out(table(spark, d, "embeddings")), wanted, by=["split"]))


def weighted_log_loss(spark, d):
    embeddings = table(spark, d, "embeddings")
    parts = split.train_val_test_split(embeddings.select("vec_id", "label"), "label", key="vec_id")
    names = parts.filter(F.col("split") == split.TRAIN).select(F.col("label").cast("string").alias("category"))
    weights = labels.class_weights(names, [str(i) for i in range(10)])
    return rounded(metrics.weighted_log_loss(centroid.score_held_out(embeddings), weights))


def automation_summary(spark, d):
    return rounded(metrics.automation_summary(score.route(scored_lines(spark, d))))


def confidence_stats(spark, d):
    return rounded(metrics.confidence_stats(scored_lines(spark, d)))


def flagged_errors(spark, d):
    return metrics.flag_errors(quality_pairs(spark, d))


def error_rows(spark, d):
    return rounded(metrics.errors(scored_lines(spark, d), keep=LINE_KEY))


def error_summary(spark, d):
    return rounded(metrics.error_summary(metrics.confusion(scored_lines(spark, d))))


def confused_pairs(spark, d):
    """With a prediction missing where it was N."""
    lines = scored_lines(spark, d).withColumn("prediction", F.nullif("prediction", F.lit("N")))
    return metrics.confused_pairs(metrics.confusion(lines), 4)


def confident_errors(spark, d):
    return rounded(metrics.confident_errors(scored_lines(spark, d), 0.97, keep=LINE_KEY))


# --- runs and savings


def _daily_history(spark, d):
    """Per event type, the mean value of each day as the figure of a round."""
    day = F.day("ts").cast("int")
    daily = table(spark, d, "events").groupBy(F.col("event_type").alias("run_id"), day.alias("epoch"))
    return daily.agg(F.round(F.avg("value"), 4).alias("f1_macro"))


def early_stop(spark, d):
    return runs.early_stop(_daily_history(spark, d), patience=3)


def best_round(spark, d):
    return runs.best_round(_daily_history(spark, d), patience=4)


def _line_runs(spark, d):
    """A run per line status, as if each came from one model."""
    lines = scored_lines(spark, d)
    figures = metrics.macro_metrics(metrics.confusion(lines, by=("method",)), by=("method",))
    sizes = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("method")).agg(
        F.avg("l_quantity").alias("training_time_seconds"),
        F.max("l_tax").alias("peak_gpu_memory_mb"),
        F.count("*").alias("total_parameters"),
        F.count_if(F.col("l_discount") > 0.05).alias("trainable_parameters"),
    )
    share = (F.col("trainable_parameters") * 100.0 / F.col("total_parameters")).alias("trainable_percentage")
    return figures.join(sizes, "method").select("*", share)


def compared_runs(spark, d):
    return rounded(runs.compare_runs(_line_runs(spark, d), ["F", "O"]))


def chosen_run(spark, d):
    return rounded(runs.choose_run(_line_runs(spark, d)))


REPLICATES = 32


def _replicates(spark, d):
    return bootstrap.replicate_counts(scored_lines(spark, d), LINE_KEY, REPLICATES, by=("method",))


def run_intervals(spark, d):
    """Figures of two runs, each with the interval of its replicates."""
    return rounded(bootstrap.intervals(_replicates(spark, d), by=("method",), level=0.9))


def run_difference(spark, d):
    return rounded(bootstrap.difference_intervals(_replicates(spark, d), "method", "F", "O", level=0.9))


def savings(spark, d):
    return rounded(runs.roi(metrics.automation_summary(score.route(scored_lines(spark, d)))))


# --- files


def csv_round_trip(spark, d):
    """All documents to CSV and back: quotes, commas, line breaks, blanks."""
    path = shared_folder(spark)
    files.write_tickets(document_tickets(spark, d), path, "csv")
    back = files.read_tickets(spark, path, "csv")
    return back.select("id", F.md5("text").alias("text_md5"), "category", "annotator_confidence")


def refused_rows(spark, d):
    """All documents as CSV, in some of which the id or the confidence is no number: what fits and what is refused."""
    path = shared_folder(spark)
    no_id = F.when(F.col("id") % 7 == 3, F.concat(F.lit("no. "), F.col("id").cast("string"))).otherwise(F.col("id").cast("string"))
    c = F.col("annotator_confidence").cast("string")
    no_number = F.when(F.col("id") % 11 == 5, F.concat(c, F.lit(" of 5"))).otherwise(c)
    docs = document_tickets(spark, d).select(no_id.alias("id"), "text", "category", no_number.alias("annotator_confidence"))
    files.write_tickets(docs, path, "csv")
    fit_rows, refused = files.read_checked(spark, path)
    both = fit_rows.withColumn("refused", F.lit(False)).unionByName(refused.drop(files.REFUSED).withColumn("refused", F.lit(True)))
    return both.select("id", F.md5("text").alias("text_md5"), "category", "annotator_confidence", "refused")


def stored_splits(spark, d):
    """Splits written as one table; one of them read back."""
    path = shared_folder(spark)
    files.write_splits(_document_splits(spark, d), path)
    held = files.read_split(spark, path, split.VALIDATION)
    return held.select("id", "category", F.md5("text").alias("text_md5"))


def stored_scores(spark, d):
    """A scored table to CSV and back."""
    path = shared_folder(spark)
    scored = score.route(scored_lines(spark, d)).select(
        F.col("l_orderkey").alias("id"),
        F.col("method").alias("text"),
        F.col("truth").alias("category"),
        F.col("l_linenumber").alias("annotator_confidence"),
        "prediction",
        "confidence",
        "decision",
    )
    files.write_scored(scored, path)
    return rounded(files.read_scored(spark, path).groupBy("category", "prediction", "decision").agg(
        F.count("*").alias("n"), F.sum("id").alias("id_sum"), F.sum("confidence").alias("confidence_sum")
    ))


def routed_output(spark, d):
    """Routed rows in a folder per decision; the review queue read back."""
    path = shared_folder(spark)
    files.write_routed(score.route(scored_lines(spark, d)).select("l_orderkey", "confidence", "decision"), path)
    queue = spark.read.parquet(path).filter("decision = 'human_review'")
    return rounded(queue.agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"), F.max("confidence").alias("max_confidence")
    ))


def stored_runs(spark, d):
    """Run records of the line runs, appended one after the other and read."""
    path = shared_folder(spark)
    full = _line_runs(spark, d)
    blank = [F.lit(v).cast(t).alias(n) for n, v, t in (("model", "m", "string"), ("weighted", True, "boolean"), ("seed", 42, "long"))]
    for name in ("F", "O"):
        run_files.append_run(full.filter(F.col("method") == name).select("*", *blank), path)
    return rounded(run_files.read_runs(spark, path))


# --- audits


def threshold_sweep(spark, d):
    return rounded(audits.threshold_sweep(scored_lines(spark, d), [0.5, 0.6, 0.7, 0.8, 0.9, 0.97]))


def reliability_bins(spark, d):
    return rounded(audits.reliability_bins(scored_lines(spark, d)))


def calibration_error(spark, d):
    return rounded(audits.calibration_error(audits.reliability_bins(scored_lines(spark, d))))


def drift_windows(spark, d):
    events = decision_stream_columns(table(spark, d, "events"))
    daily = streams.drift(events, list(EVENT_CLASSES), truth="truth")
    return rounded(daily.withColumn("window_start", F.unix_timestamp("window_start")).drop("window_end"))


def split_leakage(spark, d):
    return audits.split_leakage(_document_splits(spark, d))


def leaked_rows(spark, d):
    return audits.leaked_rows(_document_splits(spark, d)).select("id", "category", "split")


def benchmark_overlap(spark, d):
    """Held-out benchmark texts that stand in documents, and in how many."""
    pairs = audits.contained_items(table(spark, d, "benchmark"), table(spark, d, "documents"))
    return pairs.groupBy("item_id").agg(F.count("*").alias("n_documents"))


def conflicting_labels(spark, d):
    docs = table(spark, d, "documents")
    return audits.conflicting_labels(docs.select("text", F.col("source").alias("category")))


# --- calibration, threshold choice, drift as a figure


def _calibrated_lines(spark, d):
    """Line items of the test split, their confidence calibrated on the validation split, and that calibration."""
    lines = split.train_val_test_split(scored_lines(spark, d), "truth", key=LINE_KEY, labels=RETURN_FLAGS)
    model = calibrate.fit_calibration(lines.filter(F.col("split") == split.VALIDATION))
    return calibrate.calibrated(model, lines.filter(F.col("split") == split.TEST)), model


def calibrated_confidence(spark, d):
    """What every confidence of the test split becomes."""
    test, _ = _calibrated_lines(spark, d)
    return rounded(test.groupBy("raw_confidence", "confidence").agg(F.count("*").alias("n")))


def calibration_gain(spark, d):
    """The calibration error of the test split before, and what must hold of it after."""
    test, model = _calibrated_lines(spark, d)
    before = audits.calibration_error(audits.reliability_bins(test, confidence="raw_confidence")).select(F.col("ece").alias("before"))
    after = audits.calibration_error(audits.reliability_bins(test)).select(F.col("ece").alias("after"))
    steps = model.predictions.toArray()
    rising = bool((steps[1:] >= steps[:-1]).all())
    return rounded(before.join(F.broadcast(after)).select(
        F.col("before").alias("ece_before"), (F.col("after") <= F.col("before")).alias("improved"), F.lit(rising).alias("monotone")
    ))


def _priced_lines(spark, d):
    """Line items with a confidence that is another one in nearly every row."""
    return scored_lines(spark, d, F.col("l_extendedprice") / 104_729.0)


def threshold_curve(spark, d):
    return rounded(thresholds.threshold_curve(_priced_lines(spark, d)))


def chosen_threshold(spark, d):
    """The most automation that is right in 4 of 10 cases, and how well the confidence ranks."""
    lines = _priced_lines(spark, d)
    best = thresholds.choose_threshold(thresholds.threshold_curve(lines), 0.4)
    return rounded(best.join(F.broadcast(thresholds.ranking_quality(lines).select("auc"))))


def drift_scores(spark, d):
    """Divergence of every day from the first one, from stored sketches of two halves of the events."""
    confidence = F.least(F.lit(1.0), F.col("value") / 200.0).alias("confidence")
    events = decision_stream_columns(table(spark, d, "events"), confidence)
    path = shared_folder(spark)
    for k in (0, 1):
        drift.sketch(events.filter(F.col("event_id") % 2 == k)).write.mode("append").parquet(path)
    scored = drift.drift_scores(drift.merged(spark.read.parquet(path)))
    return rounded(scored.withColumn("window_start", F.unix_timestamp("window_start")))


def _label_stream_columns(decisions):
    """Labels of four fifths of the decisions, from 4 hours before to 75 hours after them."""
    delay = F.make_dt_interval(F.lit(0), (F.col("event_id") % 80 - 4).cast("int"))
    given = decisions.filter("event_id % 5 > 0")
    return given.select("event_id", (F.col("ts") + delay).alias("label_ts"), "truth")


def streamed_errors(spark, d):
    """Decisions and later labels as two streams, in files by time, out of order within a file, with one
    row at the end of each that lets the watermarks pass."""
    base = shared_folder(spark)
    decisions = decision_stream_columns(table(spark, d, "events")).select("event_id", "ts", "prediction", "truth")
    sides = {"decisions": (decisions.select("event_id", "ts", "prediction"), "ts"), "labels": (_label_stream_columns(decisions), "label_ts")}
    streams_of = []
    for name, (rows, ts) in sides.items():
        low, high = rows.agg(F.min(ts), F.max(ts)).first()
        middle = low + (high - low) / 2
        end = spark.createDataFrame([(-1 if name == "labels" else -2, high + (high - low) * 2, None)], rows.schema)
        for part in (rows.filter(F.col(ts) < middle), rows.filter(F.col(ts) >= middle), end):
            part.coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        streams_of.append(streams.read_stream(spark, f"{base}/{name}", schema=rows.schema, files_per_batch=1))
    found = outcomes.outcomes(*streams_of, key="event_id")
    streams.write_stream(found, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{base}/out").filter("event_id >= 0")
    return done.select("event_id", "status", "prediction", "truth", F.unix_timestamp("label_ts").alias("label_time"))


# --- fitted models: SQL states what must hold of them


def _fitted(spark, d, compact=False, rounds=True):
    """Train and test rows from stored splits, and a fit on them."""
    train, val, test = training.store_splits(document_tickets(spark, d), shared_folder(spark), LANGUAGES)
    if compact:
        return test, fit.fit_compact(train, val, COMPACT_FIT)
    weights = labels.class_weights(train, LANGUAGES)
    return test, fit.fit_full(train, val if rounds else None, weights, FULL_FIT)


def _claims(record):
    """What of a run record does not depend on the machine."""
    return record.select(
        "model", "method", "weighted", "seed", "total_parameters", "trainable_parameters",
        (F.col("f1_macro") >= LEAST_F1).alias("accurate"), (F.col("training_time_seconds") > 0).alias("timed"),
    )


def fitted_full(spark, d):
    """Class-weighted fit on document languages: the run record."""
    test, result = _fitted(spark, d)
    return _claims(training.evaluated(result, test, "hashed", "full"))


def fitted_compact(spark, d):
    """Unweighted fit on a projection: the run record."""
    test, result = _fitted(spark, d, compact=True)
    return _claims(training.evaluated(result, test, "projected", "compact"))


def fit_history(spark, d):
    """Where early stop and best round, as operators, put the fit's own history."""
    _, result = _fitted(spark, d)
    history = result.history_frame(spark, "full")
    found = runs.best_round(history, FULL_FIT.patience)
    kept = history.groupBy("run_id").agg(F.max("epoch").alias("last"), F.min("epoch").alias("first"))
    return found.join(kept, "run_id").select(
        "run_id", "first", (F.col("stop_epoch") == F.col("last")).alias("stops_there"),
        (F.col("best_epoch") == F.lit(result.best_epoch)).alias("keeps_the_best"),
    )


def scored_documents(spark, d):
    """The fitted model on every test document: what must hold of each record."""
    test, result = _fitted(spark, d, rounds=False)
    scored = score.score(result.model, test, keep_probs=True)
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    automatic = F.col("confidence") > THRESHOLD
    return scored.select(
        "id", F.md5("text").alias("text_md5"), F.size("probs").alias("n_probs"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.col("confidence") == F.array_max("probs")).alias("is_largest"),
        ((F.col("decision") == "automatic") == automatic).alias("decision_follows"),
    )


def scored_text(spark, d):
    """The fitted model on one document's text, alone and in the table."""
    test, result = _fitted(spark, d, rounds=False)
    one = test.orderBy("id").limit(1)
    text = one.select("text").first().text
    alone = score.score(result.model, spark.createDataFrame([(text,)], "text string")).withColumnsRenamed(
        {"prediction": "p", "confidence": "c"}
    )
    both = score.score(result.model, one).join(alone.select("text", "p", "c"), "text")
    same = (F.col("p") == F.col("prediction")) & (F.abs(F.col("c") - F.col("confidence")) < 1e-12)
    return both.select("id", same.alias("same"))


def reloaded_model(spark, d):
    """How many test rows the saved and loaded model scores, and how many of
    them differently."""
    test, result = _fitted(spark, d, rounds=False)
    path = shared_folder(spark)
    run_files.save_model(result.model, path)
    first = score.score(result.model, test).select("id", "prediction", "confidence")
    again = score.score(run_files.load_model(path), test).select(
        "id", F.col("prediction").alias("p"), F.col("confidence").alias("c")
    )
    same = (F.col("p") == F.col("prediction")) & (F.abs(F.col("c") - F.col("confidence")) < 1e-12)
    return first.join(again, "id").agg(F.count("*").alias("n"), F.count_if(~same).alias("different"))


def external_scores(spark, d):
    """A batch function from outside Spark as the model, over all embeddings."""

    def load():
        import numpy as np

        def predict(embedding):
            folded = np.asarray(embedding, dtype="float64").reshape(len(embedding), 8, -1)
            return folded.sum(axis=2) * 4.0

        return predict

    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    names = [f"c{i}" for i in range(8)]
    scored = score.score_with(load, vectors, ["embedding"], names, input_shapes=[[64]])
    return rounded(scored.select("vec_id", "prediction", "confidence", "decision"))


def wrong_labels(spark, d):
    """Documents whose language is wrong in 3 of 100 cases: what must hold of the suspects."""
    planted = draw(11, "wrong", "id") < 0.03
    other = F.when(F.col("category") == "en", "fr").otherwise("en")
    docs = document_tickets(spark, d).select("id", "text", F.when(planted, other).otherwise(F.col("category")).alias("category"), planted.alias("planted"))
    path = shared_folder(spark)
    docs.write.parquet(path)
    found = suspects.judged(suspects.out_of_fold(spark.read.parquet(path), FULL_FIT), LANGUAGES)
    hit = F.count_if(F.col("suspect") & F.col("planted"))
    return found.agg(
        F.count("*").alias("n"), F.count_if("planted").alias("n_planted"),
        (hit >= 0.9 * F.count_if("planted")).alias("found"), (hit >= 0.7 * F.count_if("suspect")).alias("mostly_planted"),
    )


def streamed_scores(spark, d):
    """The stored documents of the test split scored as a stream."""
    test, result = _fitted(spark, d, rounds=False)
    base = shared_folder(spark)
    files.write_tickets(test, f"{base}/in")
    stream = streams.read_stream(spark, f"{base}/in", schema=TICKET, files_per_batch=4)
    scored = streams.score_stream(result.model, stream).select("id", "prediction", "confidence", "decision")
    query = streams.write_stream(scored, f"{base}/out", f"{base}/checkpoint", partition_by=["decision"])
    query.awaitTermination()
    batch = score.score(result.model, test).select("id", F.col("prediction").alias("p"), F.col("confidence").alias("c"))
    same = (F.col("p") == F.col("prediction")) & (F.abs(F.col("c") - F.col("confidence")) < 1e-12)
    both = spark.read.parquet(f"{base}/out").join(batch, "id", "full")
    return both.groupBy("id").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(same), F.lit(False)).alias("same"))


def streamed_drift(spark, d):
    """The drift windows as a stream over the events, out of order in several files."""
    base = shared_folder(spark)
    events = table(spark, d, "events")
    events.repartition(4, "event_id").write.parquet(f"{base}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    daily = streams.drift(decision_stream_columns(source), list(EVENT_CLASSES), truth="truth")
    streams.write_latest(daily, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{base}/out/*").withColumn("_batch", F.regexp_extract(F.input_file_name(), r"/(\d{10})/", 1))
    last = done.join(done.agg(F.max("_batch").alias("_batch")), "_batch").drop("_batch")
    return rounded(last.withColumn("window_start", F.unix_timestamp("window_start")).drop("window_end"))


def streamed_drift_closed(spark, d):
    """Drift windows of a stream that keeps only the open ones: the earlier events, then, after a restart, the later."""
    base = shared_folder(spark)
    events = table(spark, d, "events")
    ends = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    earlier = F.col("ts") < F.lit(ends["first"] + (ends["last"] - ends["first"]) / 2) if ends["first"] else F.lit(True)
    for part in (events.filter(earlier), events.filter(~earlier)):
        part.repartition(4, "event_id").write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        daily = streams.drift(decision_stream_columns(source), list(EVENT_CLASSES), truth="truth")
        streams.write_stream(daily, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    closed = spark.read.schema(daily.schema).parquet(f"{base}/out")
    return rounded(closed.withColumn("window_start", F.unix_timestamp("window_start")).drop("window_end"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        held_out_automation,
        held_out_predictions,
        expand_quota,
        random_choices,
        generated_tickets,
        shuffled_preview,
        shuffled_positions,
        class_counts,
        class_counts_by_language,
        document_split,
        line_split_totals,
        conversation_split,
        counts_by_split,
        split_row_counts,
        encoded_labels,
        decoded_labels,
        labelled_projection,
        class_weights,
        row_weights,
        tokenized_documents,
        fixed_length_tokens,
        batch_padded_tokens,
        vocabulary,
        token_ids,
        example_token_ids,
        mapped_batches,
        softmax_rows,
        routed_lines,
        rounded_confidence,
        confusion,
        confusion_matrix,
        quality_accuracy,
        macro_metrics,
        macro_metrics_listed,
        class_report,
        named_metrics,
        scored_metrics,
        weighted_log_loss,
        automation_summary,
        confidence_stats,
        flagged_errors,
        error_rows,
        error_summary,
        confused_pairs,
        confident_errors,
        early_stop,
        best_round,
        compared_runs,
        chosen_run,
        run_intervals,
        run_difference,
        savings,
        csv_round_trip,
        refused_rows,
        stored_splits,
        stored_scores,
        routed_output,
        stored_runs,
        threshold_sweep,
        reliability_bins,
        calibration_error,
        drift_windows,
        calibrated_confidence,
        calibration_gain,
        threshold_curve,
        chosen_threshold,
        drift_scores,
        streamed_errors,
        split_leakage,
        leaked_rows,
        benchmark_overlap,
        conflicting_labels,
        fitted_full,
        fitted_compact,
        fit_history,
        scored_documents,
        reloaded_model,
        external_scores,
        wrong_labels,
        scored_text,
        streamed_scores,
        streamed_drift,
        streamed_drift_closed,
    )
}
