"""Nearest-centroid classifier over embeddings, as one DataFrame plan."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.fixed_values import SEED
from ticketflow.functions import scores
from ticketflow.operators.split import TRAIN, train_val_test_split

# Sharpens the softmax over the small inner products.
TEMPERATURE = 120.0


def centroids(train: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """``label, centroid``: the mean vector per class. Partial means combine
    before the shuffle, so a dominant class costs one vector per task."""
    vector = array_to_vector(F.col(embedding).cast("array<double>"))
    return train.groupBy(label).agg(vector_to_array(Summarizer.mean(vector)).alias("centroid"))


def score_held_out(
    df: DataFrame,
    label: str = "label",
    key: str = "vec_id",
    embedding: str = "embedding",
    seed: int = SEED,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """``key, split, truth, logits, probs, prediction, confidence`` of the rows
    outside the train split.

    The centroids, one vector per class, are gathered into one value that all
    tasks get, so the rows are scored where they are. A scalar may not stand in
    a higher-order function, so it is a column of the one step that needs it.
    """
    split = train_val_test_split(df.select(key, label, embedding), label, seed=seed, key=key)
    learned = centroids(split.filter(F.col("split") == TRAIN), label, embedding)
    table = learned.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "centroid")))).scalar()
    logits = F.transform("_table", lambda c: scores.dot(F.col(embedding), c["centroid"]) * F.lit(temperature))
    return (
        split.filter(F.col("split") != TRAIN)
        .withColumn("_table", table)
        .select(key, "split", label, logits.alias("logits"), F.transform("_table", lambda c: c["l"]).alias("_names"))
        .withColumn("probs", scores.softmax("logits"))
        .withColumn("prediction", F.get("_names", scores.argmax("probs")))
        .withColumn("confidence", F.array_max("probs"))
        .select(key, "split", F.col(label).alias("truth"), "logits", "probs", "prediction", "confidence")
    )
