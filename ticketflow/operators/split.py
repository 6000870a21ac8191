"""Exact, seeded, stratified splits of tables of any size.

Rows are ordered by a keyed hash inside their class and cut at the class
allocation. The cut is found in two key-only scans: bucket counts say how many
rows a class has and which hash bucket holds the cut, and only that bucket's
rows are ranked. Shares are allotted by Spark, as there may be any number of
classes. The hash at each
cut, one value per class, is then all that a split is: rows are labelled where
they are, by comparing their hash with it, and using the result again costs
nothing but its scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.fixed_values import SEED
from ticketflow.functions.draws import hash_hex
from ticketflow.operators.rank import bucket
from ticketflow.schema import MAX_INLINE_ROWS, inline_table
from ticketflow.session import written

#: Classes that one task puts in order, and tasks that do so at most.
CLASSES, RANGES = 10_000, 64
TRAIN, VALIDATION, TEST = "train", "validation", "test"


def largest_remainder(counts: Sequence[int], draws: int) -> list[int]:
    """Share ``draws`` over classes in proportion to ``counts``; what rounding
    leaves goes to the largest remainders, equal ones in class order."""
    total = sum(counts)
    base = [n * draws // total for n in counts]
    order = sorted(range(len(counts)), key=lambda i: -(counts[i] * draws % total))
    for i in order[: draws - sum(base)]:
        base[i] += 1
    return base


def first_side(total: int, classes: int, smallest: int, test_size: Decimal) -> int:
    """Rows that stay on the first side. Raises ValueError where an exact stratified split is impossible."""
    n_test = math.ceil(test_size * total)
    n_train = total - n_test
    if classes and smallest < 2:
        raise ValueError("every class needs at least 2 rows")
    if min(n_train, n_test) < max(classes, 1):
        raise ValueError(f"sides of {n_train} and {n_test} rows cannot hold {classes} classes")
    return n_train


def allotted(classes: DataFrame, test_size: Decimal, name: str, n: str = "_n") -> DataFrame:
    """``classes`` with ``name``, the share of each on the first side: `largest_remainder` of any number of classes.

    ``_class, _place`` and ``n`` are read. Classes are written in the order of their remainders, range by range; a class
    is among the first if its place in its range and the sizes of the ranges before say so.
    """
    sums = classes.agg(F.sum(n), F.count(F.lit(1)), F.min(n)).first()
    total, found = sums[0] or 0, sums[1]
    draws = first_side(total, found, sums[2] or 0, test_size)
    wide = "decimal(19,0)"
    exact = F.col(n).cast(wide) * F.lit(draws).cast(wide)
    whole = F.lit(total).cast(wide)
    shares = classes.withColumn("_rest", exact % whole).withColumn("_base", ((exact - F.col("_rest")) / whole).cast("long"))
    order = [F.desc("_rest"), F.asc("_place"), F.asc_nulls_last("_class")]
    ranges = min(RANGES, found // CLASSES + 1)
    ordered = shares.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the number of the task, and the place in it
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "shares")
    task = F.shiftright("_at", 33).cast("int")
    sizes = [0] * ranges
    base = 0
    for r in ordered.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum("_base").alias("base")).collect():
        sizes[r.task] = r.n
        base += r.base
    before = F.get(F.array(*[F.lit(k) for k in accumulate([0, *sizes[:-1]])]), task)
    rank = before + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    more = (rank < draws - base).cast("long")
    return ordered.withColumn(name, F.col("_base") + more).drop("_rest", "_base", "_at")


def bucket_counts(df: DataFrame, strat: str, h: Column) -> DataFrame:
    """``_class, _bucket, _size``: all that the allocation and the place of the
    cuts need. Kept, so that both read the source once; lost blocks are
    computed again."""
    keys = df.select(F.col(strat).alias("_class"), bucket(h).alias("_bucket"))
    counts = keys.groupBy("_class", "_bucket").agg(F.count("*").alias("_size"))
    return counts.persist(StorageLevel.MEMORY_AND_DISK)


def class_sizes(counts: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """``_class, _n, _place``: rows per class, and its place in ``labels``; others stand behind them."""
    place = F.lit(0)
    if labels:
        at = F.array_position(F.array(*[F.lit(name) for name in labels]), F.col("_class"))
        place = F.when(at > 0, at).otherwise(F.lit(len(labels) + 1))
    return counts.groupBy("_class").agg(F.sum("_size").alias("_n")).withColumn("_place", place.cast("long"))


def _cut_hashes(keys: DataFrame, counts: DataFrame, classes: DataFrame, cuts: Sequence[str]) -> DataFrame:
    """``_class`` and, per cut, ``_<cut>``: the hash of the last row before it, from ``_class, _h``.

    ``classes`` has, per cut, the rows before it; without any, the hash is null, or the class missing. Raises
    ValueError if the next row has the same hash: then the key repeats, and the side would
    be larger than asked for.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_cut"), F.col(c).alias("_upto")) for c in cuts])).alias("c")
    wanted = classes.select("_class", each).select("_class", "c.*").filter("_upto > 0")
    earlier = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = counts.withColumn("_below", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    at_cut = (
        bounds.alias("b")
        .join(wanted.alias("w"), F.expr("b._class <=> w._class"))
        .filter("w._upto > b._below and w._upto <= b._below + b._size")
        .selectExpr("w._cut", "b._class", "b._bucket", "w._upto - b._below as _nth")
    )
    # its size is known once written: below Spark's bound it is broadcast, else joined by class and bucket
    at_cut = written(at_cut, "cuts")
    in_bucket = Window.partitionBy("_cut", "_class").orderBy("_h")
    found = (
        keys.withColumn("_bucket", bucket(F.col("_h"))).alias("k")
        .join(at_cut.alias("c"), F.expr("k._class <=> c._class and k._bucket = c._bucket"))
        .select("c._cut", "k._class", "k._h", "c._nth")
        .withColumn("_next", F.lead("_h").over(in_bucket))
        .withColumn("_rank", F.row_number().over(in_bucket))
        .filter("_rank = _nth")
    )
    hashes = [F.max(F.when(F.col("_cut") == c, F.col("_h"))).alias(f"_{c}") for c in cuts]
    repeats = F.max(F.coalesce(F.col("_h") == F.col("_next"), F.lit(False))).alias("_repeats")
    ends = written(found.groupBy("_class").agg(*hashes, repeats), "ends")
    if ends.filter("_repeats").limit(1).count():
        raise ValueError("the key does not identify rows: it repeats at a cut")
    return ends.drop("_repeats")


def _small(ends: DataFrame) -> DataFrame:
    """A table of few rows as an inline one to broadcast; a larger one as it is."""
    rows = ends.limit(MAX_INLINE_ROWS + 1).toArrow()
    if rows.num_rows > MAX_INLINE_ROWS:
        return ends
    table = inline_table(ends.sparkSession, {c: rows.column(c).combine_chunks() for c in rows.column_names})
    return F.broadcast(table.withColumn("_class", F.col("_class").cast(ends.schema["_class"].dataType)))


def _assign(df: DataFrame, strat: str, h: Column, counts: DataFrame, classes: DataFrame, cuts: Sequence[str], last: str):
    keys = df.select(F.col(strat).alias("_class"), h.alias("_h"))
    ends = _cut_hashes(keys, counts, classes, cuts)
    counts.unpersist()
    side = " ".join(f"WHEN _h <= _{name} THEN '{name}'" for name in cuts)
    return (
        df.withColumn("_h", h)
        .join(_small(ends), F.col(strat).eqNullSafe(F.col("_class")), "left")
        .withColumn("split", F.expr(f"CASE {side} ELSE '{last}' END"))
        .drop("_class", "_h", *[f"_{name}" for name in cuts])
    )


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def stratified_split(
    df: DataFrame,
    strat: str = "category",
    test_size: str | Decimal = "0.30",
    seed: int = SEED,
    key: str | Sequence[str] = "id",
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``split`` in {train, test} with exact side and class sizes.

    ``key`` must identify a row. ``labels`` gives the class order that breaks
    ties between equal remainders; without it classes are sorted by value.
    """
    h = hash_hex(seed, "split", *_keys(key))
    buckets = bucket_counts(df, strat, h)
    classes = allotted(class_sizes(buckets, labels), Decimal(test_size), TRAIN)
    return _assign(df, strat, h, buckets, classes, [TRAIN], TEST)


def train_val_test_split(
    df: DataFrame,
    strat: str = "category",
    held_out: str | Decimal = "0.30",
    test_share: str | Decimal = "0.50",
    seed: int = SEED,
    key: str | Sequence[str] = "id",
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``split`` in {train, validation, test}: ``held_out`` of the rows
    leave the training side, and ``test_share`` of those become the test."""
    h = hash_hex(seed, "split", *_keys(key))
    buckets = bucket_counts(df, strat, h)
    classes = allotted(class_sizes(buckets, labels), Decimal(held_out), TRAIN)
    rest = classes.withColumn("_rest_n", F.col("_n") - F.col(TRAIN))
    upto = allotted(rest, Decimal(test_share), VALIDATION, "_rest_n")
    upto = upto.withColumn(VALIDATION, F.col(TRAIN) + F.col(VALIDATION))
    return _assign(df, strat, h, buckets, upto, [TRAIN, VALIDATION], TEST)
