"""Fit text classifiers with Spark ML and keep a record of each run."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    DCT,
    IDF,
    ElementwiseProduct,
    HashingTF,
    IDFModel,
    IndexToString,
    RegexTokenizer,
    SQLTransformer,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.fixed_values import LABELS, PATIENCE, ROUNDS, SEED
from ticketflow.functions.scores import argmax
from ticketflow.functions.text import SEPARATORS
from ticketflow.operators.labels import encode_label
from ticketflow.operators.metrics import confusion, macro_metrics, scored_metrics
from ticketflow.operators.runs import run_record
from ticketflow.schema import HISTORY


#: Figures by name: from the probabilities and the label id to an aggregate.
Functions = dict[str, Callable[[Column, Column], Column]] | None

#: Components of a compact fit, unless its configuration says otherwise.
COMPONENTS = 256


@dataclass(frozen=True)
class FitConfig:
    """A round adds ``iterations_per_round`` passes over the training rows.
    ``max_tokens`` None reads whole texts; a number keeps the first tokens of
    each, as a model with a fixed input length would. ``partitions`` spreads
    training rows that lie in fewer pieces than the cluster has cores.
    ``components`` is the size that a compact fit projects the features to."""

    features: int = 1 << 14
    components: int | None = None
    max_tokens: int | None = None
    reg_param: float = 0.001
    rounds: int = ROUNDS
    iterations_per_round: int = 5
    patience: int = PATIENCE
    partitions: int | None = None
    aggregation_depth: int = 2
    seed: int = SEED
    labels: Sequence[str] = LABELS


@dataclass
class FitResult:
    model: PipelineModel
    history: list[tuple]
    best_epoch: int
    seconds: float
    weighted: bool
    config: FitConfig
    params: dict = field(default_factory=dict)
    figures: list[dict] = field(default_factory=list)

    def history_frame(self, spark, run_id: str = "run") -> DataFrame:
        """One row per round: its macro metrics, and the figures that were asked for."""
        names = list(self.figures[0]) if self.figures else []
        schema = T.StructType([*HISTORY.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
        own = self.figures or [{}] * len(self.history)
        return spark.createDataFrame([(run_id, *row, *(f[n] for n in names)) for row, f in zip(self.history, own)], schema)


def counter(cfg: FitConfig) -> list:
    """Stages from text to hashed token counts; they learn nothing."""
    tokens = RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=SEPARATORS)
    counts = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=cfg.features)
    if not cfg.max_tokens:
        return [tokens, counts]
    cut = SQLTransformer(statement=f"SELECT *, slice(_tokens, 1, {int(cfg.max_tokens)}) AS _kept FROM __THIS__")
    return [tokens, cut, counts.setInputCol("_kept")]


def projection(cfg: FitConfig, source: str, target: str) -> list:
    """Stages that project ``features`` numbers to ``components``; they learn nothing and hold no matrix.

    A subsampled randomized cosine transform: every feature gets a random sign, the cosine transform spreads each over all
    coordinates, and a random choice of these is kept. Lengths and distances are kept up to a
    factor near 1, as by a matrix of random signs, at n log n per row.
    """
    rng = random.Random(cfg.seed)
    scale = math.sqrt(cfg.features / cfg.components)
    signs = [scale * rng.choice((-1.0, 1.0)) for _ in range(cfg.features)]
    kept = sorted(rng.sample(range(cfg.features), cfg.components))
    return [
        ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol=source, outputCol="_signed"),
        DCT(inputCol="_signed", outputCol="_spread"),
        VectorSlicer(inputCol="_spread", outputCol=target, indices=kept),
    ]


def weigher(cfg: FitConfig) -> Pipeline:
    """Stages from counts to features, learned without labels and then frozen:
    inverse document frequency, and a projection if ``components`` is set."""
    if not cfg.components:
        return Pipeline(stages=[IDF(inputCol="_counts", outputCol="_features")])
    return Pipeline(stages=[IDF(inputCol="_counts", outputCol="_idf"), *projection(cfg, "_idf", "_features")])


def _prepare(df: DataFrame, cfg: FitConfig, text: str, category: str, weights: DataFrame | None) -> DataFrame:
    """``_text, label[, weight]`` of the rows with a known label, and nothing
    else; the label column carries the class count."""
    rows = encode_label(df.select(text, category), cfg.labels, category).filter("label_id is not null")
    names = {"ml_attr": {"type": "nominal", "name": "label", "vals": list(cfg.labels)}}
    columns = [
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.col("label_id").cast("double").alias("label", metadata=names),
    ]
    if weights is not None:
        per_class = weights.select(F.col("category").alias(category), "weight")
        rows = rows.join(per_class, category, "left")
        missing = F.raise_error(F.concat(F.lit("no weight for class "), F.col(category))).cast("double")
        columns.append(F.coalesce("weight", missing).alias("weight"))
    return rows.select(*columns)


def _classifier(cfg: FitConfig, rounds: int, weighted: bool) -> LogisticRegression:
    lr = LogisticRegression(
        featuresCol="_features",
        labelCol="label",
        probabilityCol="_probability",
        rawPredictionCol="_logits",
        predictionCol="_id",
        family="multinomial",
        regParam=cfg.reg_param,
        maxIter=rounds * cfg.iterations_per_round,
        tol=0.0,
        aggregationDepth=cfg.aggregation_depth,
    )
    return lr.setWeightCol("weight") if weighted else lr


def _evaluate(model: LogisticRegressionModel, rows: DataFrame, functions: Functions = None) -> tuple[tuple, dict]:
    """Macro metrics, and the user's figures of probabilities and label ids."""
    probs = vector_to_array("_probability")
    scored = model.transform(rows).select(F.col("label").cast("int").alias("truth"), argmax(probs).alias("prediction"), probs.alias("probs"))
    figures = scored_metrics(scored, functions).first().asDict() if functions else {}
    return tuple(macro_metrics(confusion(scored)).first()), {k: None if v is None else float(v) for k, v in figures.items()}


def _fit(train, val, weights, cfg: FitConfig, text: str, category: str, functions: Functions = None) -> FitResult:
    """Fit for 1, 2, ... rounds until the validation score has not improved
    for ``patience`` rounds; keep the best. Each fit starts anew, and its
    passes repeat those of the shorter fits exactly.

    The frames that every round reads are kept in memory or on the executors'
    disks; lost blocks are computed again from the source.
    """
    start = time.perf_counter()
    weighted = weights is not None
    counting = PipelineModel(stages=counter(cfg))
    kept = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]

    try:
        columns = ["label"] + (["weight"] if weighted else [])
        labelled = _prepare(train, cfg, text, category, weights)
        if cfg.partitions:
            labelled = labelled.repartition(cfg.partitions)
        counts = keep(counting.transform(labelled).select("_counts", *columns))
        frozen = weigher(cfg).fit(counts)
        rows = frozen.transform(counts).select("_features", *columns)
        if cfg.components:
            rows = keep(rows)
        history, own, best, best_epoch, stale = [], [], None, cfg.rounds, 0
        if val is None:
            best = _classifier(cfg, cfg.rounds, weighted).fit(rows)
        else:
            held = counting.transform(_prepare(val, cfg, text, category, None))
            held = keep(frozen.transform(held).select("_features", "label"))
        for epoch in range(1, cfg.rounds + 1) if val is not None else ():
            head = _classifier(cfg, epoch, weighted).fit(rows)
            figures, more = _evaluate(head, held, functions)
            own.append(more)
            improved = not history or figures[1] > history[best_epoch - 1][2]
            history.append((epoch, *figures))
            if improved:
                best, best_epoch, stale = head, epoch, 0
            else:
                stale += 1
                if stale >= cfg.patience:
                    break
    finally:
        for df in kept:
            df.unpersist()
    names = IndexToString(inputCol="_id", outputCol="_label", labels=list(cfg.labels))
    model = PipelineModel(stages=[*counting.stages, *frozen.stages, best, names])
    seconds = time.perf_counter() - start
    return FitResult(model, history, best_epoch, seconds, weighted, cfg, param_counts(model), own if functions else [])


def fit_full(
    train: DataFrame,
    val: DataFrame | None = None,
    weights: DataFrame | None = None,
    cfg: FitConfig = FitConfig(),
    text: str = "text",
    category: str = "category",
    functions: Functions = None,
) -> FitResult:
    """Fit on all hashed features; with ``weights`` the loss is class-weighted. ``functions``, as of scored_metrics(),
    are evaluated on the validation rows after every round."""
    return _fit(train, val, weights, replace(cfg, components=None), text, category, functions)


def fit_compact(
    train: DataFrame,
    val: DataFrame | None = None,
    cfg: FitConfig = FitConfig(components=COMPONENTS),
    text: str = "text",
    category: str = "category",
    functions: Functions = None,
) -> FitResult:
    """Fit a small unweighted head on a frozen low-dimensional projection."""
    if not cfg.components:
        raise ValueError("a compact fit needs components")
    if cfg.components > cfg.features:
        raise ValueError(f"a projection to {cfg.components} needs as many features, not {cfg.features}")
    return _fit(train, val, None, cfg, text, category, functions)


def param_counts(model: PipelineModel) -> dict:
    """``total_parameters, trainable_parameters, trainable_percentage``; what
    the feature stages learned counts as frozen."""
    frozen = trainable = 0
    for stage in model.stages:
        if isinstance(stage, IDFModel):
            frozen += stage.idf.size
        elif isinstance(stage, ElementwiseProduct):
            frozen += stage.getScalingVec().size
        elif isinstance(stage, LogisticRegressionModel):
            trainable += stage.coefficientMatrix.numRows * stage.coefficientMatrix.numCols
            trainable += stage.interceptVector.size
    total = frozen + trainable
    return {
        "total_parameters": total,
        "trainable_parameters": trainable,
        "trainable_percentage": trainable / total * 100 if total else 0.0,
    }


def record_of(result: FitResult, metrics: DataFrame, model: str, method: str) -> DataFrame:
    """The run record of a fit with its test figures, one row of macro_metrics()."""
    figures = metrics.first().asDict()
    return run_record(
        metrics.sparkSession,
        model=model,
        method=method,
        weighted=result.weighted,
        training_time_seconds=result.seconds,
        seed=result.config.seed,
        **figures,
        **result.params,
    )
