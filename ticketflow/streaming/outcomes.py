"""Errors after deployment: decisions meet the labels that people give them later, both as streams.

A decision waits for its label until the label can no longer come: the watermarks of both streams say when.
State holds the decisions and labels of that time only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ticketflow.fixed_values import ERROR, OK

#: Besides OK and ERROR: a decision without a label in time, and a label without a decision.
UNLABELLED, STRAY = "UNLABELLED", "STRAY"


def outcomes(
    decisions: DataFrame,
    labels: DataFrame,
    within: str = "2 days",
    late: str = "1 hour",
    key: str = "id",
    ts: str = "ts",
    label_ts: str = "label_ts",
) -> DataFrame:
    """``key, ts, prediction, truth, label_ts, status`` of every decision, and of every label that meets none.

    ``decisions`` has key, ts, prediction; ``labels`` has key, label_ts, truth. A label counts if it was given at the time of its decision
    or up to ``within`` after it. Status is OK or ERROR; UNLABELLED once no label can come any more; STRAY for a label given too early, too late
    or to no decision (its key stands in ``key``, ts and prediction are null). A decision with several labels comes out with each. Works on tables, and in append
    mode on streams: rows that arrive more than ``late`` behind their stream are dropped, see dropped_rows().
    """
    d = decisions.select(F.col(key).alias("_d"), F.col(ts).alias("ts"), "prediction").withWatermark("ts", late)
    t = labels.select(F.col(key).alias("_t"), F.col(label_ts).alias("label_ts"), "truth").withWatermark("label_ts", late)
    in_time = (F.col("label_ts") >= F.col("ts")) & (F.col("label_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    both = d.join(t, (F.col("_d") == F.col("_t")) & in_time, "full_outer")
    right = F.coalesce(F.col("prediction") == F.col("truth"), F.lit(False))
    status = (
        F.when(F.col("ts").isNull(), STRAY)
        .when(F.col("label_ts").isNull(), UNLABELLED)
        .when(right, OK)
        .otherwise(ERROR)
    )
    return both.select(F.coalesce("_d", "_t").alias(key), "ts", "prediction", "truth", "label_ts", status.alias("status"))


def error_windows(found: DataFrame, window: str = "1 day") -> DataFrame:
    """``window_start, decided, labelled, errors, error_rate`` by the time of the decision, of stored outcomes.

    The rate is over labelled decisions; null where there are none."""
    known = found.filter(F.col("status") != STRAY)
    counts = known.groupBy(F.window("ts", window).alias("_w")).agg(
        F.count("*").alias("decided"),
        F.count_if(F.col("status").isin(OK, ERROR)).alias("labelled"),
        F.count_if(F.col("status") == ERROR).alias("errors"),
    )
    return counts.select(F.col("_w.start").alias("window_start"), "decided", "labelled", "errors", F.try_divide("errors", "labelled").alias("error_rate"))


def dropped_rows(query: StreamingQuery) -> int:
    """Rows of the last batches that came too late to be joined."""
    operators = (o for p in query.recentProgress for o in p["stateOperators"])
    return sum(o.get("numRowsDroppedByWatermark", 0) for o in operators)


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows in state after each of the last batches."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
