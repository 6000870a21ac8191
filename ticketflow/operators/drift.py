"""How far a window of decisions has drifted from a reference window, as one figure.

A window is kept as a sketch: how many confidences fall into each of ``CELLS`` cells of [0, 1], and how many rows
each class got. Sketches of parts of a window are merged by adding, whatever their number, and a quantile read from
one is off by less than 1 / CELLS. The reference's quantiles cut its cells into bins of about the same weight; the
shares of two windows in these bins are what the divergences compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a sketch: the error of a quantile is below 1 / CELLS.
CELLS, BINS = 1024, 10
#: Added to every bin, so that an empty one has a share.
PRIOR = 0.5


def cell(confidence: str | Column, cells: int = CELLS) -> Column:
    """The cell of a confidence; what lies outside of [0, 1] falls into the first or the last, and a missing one has none."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    inside = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(c * cells))).cast("int")
    return F.when(c.isNotNull() & ~F.isnan(c), inside)


def sketch(
    df: DataFrame,
    window: str = "1 day",
    late: str = "1 hour",
    ts: str = "ts",
    confidence: str = "confidence",
    prediction: str = "prediction",
    cells: int = CELLS,
) -> DataFrame:
    """``window_start, cell, class, n``: the rows of every tumbling window by confidence and class.

    Works on tables and, in append mode, on streams: a window comes out once when the watermark has passed its end, with at most
    cells * classes rows of state, which are then dropped; rows later than ``late`` after that are dropped. Rows without a time are
    in no window.
    """
    keys = [F.window(ts, window).alias("_w"), cell(confidence, cells).alias("cell"), F.col(prediction).alias("class")]
    found = df.withWatermark(ts, late).groupBy(*keys).agg(F.count("*").alias("n"))
    return found.select(F.col("_w.start").alias("window_start"), "cell", "class", "n")


def merged(*sketches: DataFrame) -> DataFrame:
    """One sketch of all rows that several saw."""
    whole = sketches[0]
    for more in sketches[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("window_start", "cell", "class").agg(F.sum("n").alias("n"))


def _by_cell(found: DataFrame) -> DataFrame:
    return found.filter("cell is not null").groupBy("window_start", "cell").agg(F.sum("n").alias("n"))


def quantile_cells(found: DataFrame, at: float = 0.5) -> DataFrame:
    """``window_start, quantile_cell``: the cell that holds the confidence of rank ceil(at * n) of each window."""
    upto = Window.partitionBy("window_start").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("window_start")
    ranked = _by_cell(found).withColumn("_upto", F.sum("n").over(upto)).withColumn("_rank", F.ceil(F.sum("n").over(whole) * at))
    return ranked.filter("_upto >= _rank").groupBy("window_start").agg(F.min("cell").alias("quantile_cell"))


def reference_bins(found: DataFrame, reference: Column, cells: int = CELLS, bins: int = BINS) -> DataFrame:
    """``cell, bin`` for every cell: bin by how much of the reference window lies below it. `cells` rows."""
    own = _by_cell(found.filter(reference)).groupBy("cell").agg(F.sum("n").alias("n"))
    grid = found.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell")).join(own, "cell", "left")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(before), F.lit(0))
    total = F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    place = F.least(F.lit(bins - 1), F.floor(below * bins / total))
    return grid.select("cell", F.coalesce(place, F.lit(0)).cast("int").alias("bin"))


def divergences(counts: DataFrame, reference: Column, prior: float = PRIOR) -> DataFrame:
    """``window_start, key, n`` to ``window_start, psi, js``: population stability index, and Jensen-Shannon
    divergence in bits, of each window's shares against the reference's. Keys are those that occur in any window."""
    keys = counts.agg(F.collect_set(F.struct("key")).alias("_keys"))  # bins, or the classes of a model
    every = counts.select("window_start").distinct().join(F.broadcast(keys)).select("window_start", F.inline("_keys"))
    seen = counts.select(F.col("window_start").alias("_w"), F.col("key").alias("_k"), "n")
    own = every.join(seen, (F.col("_w") == F.col("window_start")) & F.col("_k").eqNullSafe(F.col("key")), "left")
    own = own.select("window_start", "key", (F.coalesce("n", F.lit(0)) + prior).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("window_start"))
    shares = own.withColumn("p", share)
    base = shares.filter(reference).groupBy(F.col("key").alias("_k")).agg(F.avg("p").alias("q"))
    both = shares.join(base, F.col("_k").eqNullSafe(F.col("key")))
    p, q, m = F.col("p"), F.col("q"), (F.col("p") + F.col("q")) / 2
    return both.groupBy("window_start").agg(
        F.sum((p - q) * F.ln(p / q)).alias("psi"),
        (F.sum(p * F.ln(p / m) + q * F.ln(q / m)) / (2 * F.ln(F.lit(2.0)))).alias("js"),
    )


def drift_scores(found: DataFrame, reference: Column | None = None, cells: int = CELLS, bins: int = BINS, prior: float = PRIOR) -> DataFrame:
    """``window_start, n, median_cell, psi_confidence, js_confidence, psi_class, js_class`` of a sketch's windows.

    ``reference`` says which windows are the reference, by ``window_start``; the first one by default. Confidence figures leave
    out rows without one. The reference itself scores 0.
    """
    if reference is None:
        first = found.agg(F.min("window_start").alias("first")).first()["first"]
        reference = F.col("window_start") == F.lit(first)
    placed = _by_cell(found).join(reference_bins(found, reference, cells, bins), "cell")
    by_bin = placed.groupBy("window_start", F.col("bin").alias("key")).agg(F.sum("n").alias("n"))
    by_class = found.groupBy("window_start", F.col("class").alias("key")).agg(F.sum("n").alias("n"))
    confidence = divergences(by_bin, reference, prior).withColumnsRenamed({"psi": "psi_confidence", "js": "js_confidence"})
    classes = divergences(by_class, reference, prior).withColumnsRenamed({"psi": "psi_class", "js": "js_class"})
    medians = quantile_cells(found).withColumnRenamed("quantile_cell", "median_cell")
    rows = found.groupBy("window_start").agg(F.sum("n").alias("n"))
    return rows.join(medians, "window_start", "left").join(confidence, "window_start", "left").join(classes, "window_start")
