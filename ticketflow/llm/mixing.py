"""Mixing sources to target weights by thresholds on a hash, without sorting.

Every document has a fixed hash. A source that needs `q` whole passes and a part
takes each document q times, and once more if its hash is at or below the
source's threshold. Thresholds of growing budgets are nested: a larger budget
takes all that a smaller one took. To find them, sizes are summed by source and
hash bucket; only the bucket that holds the threshold is summed again, by finer
buckets, and what is left of it then, a few rows, is looked at row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.llm import tables

#: Hex digits of the hash, and of one level of buckets (4,096 of them).
HASH_DIGITS, LEVEL_DIGITS = 15, 3
#: Levels of buckets before rows are looked at: 1 in 16.7 million rows is left then.
LEVELS = 2
#: Production parameters: weights in the order of sources, share of all sizes, most passes.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def source_key() -> Column:
    """Null as a source of its own, after all others."""
    return F.struct(F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name"))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """id, source, size (words) and hash; rows that are equal in id and text share a hash."""
    text = tables.text_of()
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text))
    digits = F.substring(F.md5(key), 1, HASH_DIGITS)
    return docs.select(
        F.col("doc_id").alias("id"),
        source_key().alias("source"),
        F.regexp_count(text, F.lit(tables.WORD)).cast("long").alias("size"),
        F.conv(digits, 16, 10).cast("long").alias("hash"),
        *more,
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: size, target. One row per source, so its windows need no partition.

    The budget is share * all sizes, dealt by weight; a target stops at most * size and
    the rest is dealt anew. In the order of cap per weight, the capped sources
    come first: a source is capped if the even level left by those before it is
    not below its own cap. Empty sources have target 0.
    """
    order = Window.orderBy("source")
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    ranked = ranked.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "source")
    every = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        (F.lit(share) * F.sum("size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
    )
    level = level.withColumn("free", F.col("left") * F.col("weight") < F.col("cap") * F.col("open"))
    first = F.struct(F.col("cap") / F.col("weight"), "source")
    start = F.min_by(F.struct("left", "open"), F.when(F.col("free"), first)).over(every)
    dealt = level.withColumn("start", start)
    target = F.when(F.col("free"), F.col("start.left") * F.col("weight") / F.col("start.open"))
    return dealt.select("source", "size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _bucket(level: int) -> Column:
    """The first digits of the hash, so many levels of them."""
    return F.shiftright("hash", 4 * (HASH_DIGITS - LEVEL_DIGITS * level))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with passes and cut: a document is taken passes + (hash <= cut) times.

    The cut is the document whose taking brings the source nearest to its target;
    of two as near, the smaller.
    """
    part = F.col("target") - F.col("passes") * F.col("size")
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    goals = goals.withColumn("passes", passes).withColumn("part", part)
    # what is below the bucket that holds the threshold, and that bucket
    open_ = goals.select("source", "part", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("at"))
    rows = sizes
    for level in range(1, LEVELS + 2):
        key = _bucket(level) if level <= LEVELS else F.col("hash")
        if level > 1:
            inside = (rows["source"] == open_["source"]) & (_bucket(level - 1) == open_["at"])
            rows = sizes.join(open_.select("source", "at"), inside, "left_semi")
        summed = rows.groupBy("source", key.alias("key")).agg(F.sum("size").alias("sum"))
        running = Window.partitionBy("source").orderBy("key")
        summed = summed.withColumn("upto", F.sum("sum").over(running))
        summed = summed.join(open_, "source").withColumn("reached", F.col("below") + F.col("upto"))
        if level > LEVELS:
            break
        # the first bucket that passes the part; if none does, the last one
        over = F.when(F.col("reached") > F.col("part"), F.col("key"))
        at = summed.groupBy("source").agg(F.coalesce(F.min(over), F.max("key")).alias("at"))
        open_ = tables.stored(
            summed.drop("at").join(at, "source")
            .filter(F.col("key") == F.col("at"))
            .select("source", "part", (F.col("reached") - F.col("sum")).alias("below"), "at"),
            "bucket",
        )
    # taking nothing of the bucket is a choice too: the cut is then just below it
    none = open_.select(
        "source", "part", (F.shiftleft("at", 4 * (HASH_DIGITS - LEVEL_DIGITS * LEVELS)) - 1).alias("key"),
        F.col("below").alias("reached"),
    )
    ends = summed.select("source", "part", "key", "reached").unionByName(none)
    nearest = F.struct(F.abs(F.col("reached") - F.col("part")), "key")
    cuts = ends.groupBy("source").agg(F.min_by("key", nearest).alias("cut"))
    return goals.join(cuts, "source").select("source", "size", "target", "passes", "cut")


def _cuts(sizes: DataFrame, weights, share: float, most: int) -> DataFrame:
    goals = tables.stored(targets(sizes, weights, share, most), "targets")
    return tables.stored(thresholds(sizes, goals).withColumnRenamed("size", "source_size"), "cuts")


def _copies(most: int) -> Column:
    return F.least(F.col("passes") + (F.col("hash") <= F.col("cut")).cast("long"), F.lit(most)).cast("int")


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per row of docs: id, size, hash, source_size, target, copies.

    Null text has size 0; null is one source, after all others. Equal rows get
    equal copies. An empty table gives an empty result. Reruns agree: the hash
    depends on id and text alone. Columns other than doc_id, text and source are not read.
    """
    sizes = tables.stored(sized(docs), "sizes")
    cuts = _cuts(sizes, weights, share, most)
    return sizes.join(cuts, "source").select("id", "size", "hash", "source_size", "target", _copies(most).alias("copies"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed table: rows of docs, each as often as the plan takes it, in docs' columns."""
    cuts = _cuts(tables.stored(sized(docs), "sizes"), weights, share, most)
    rows = sized(docs, F.struct(*docs.columns).alias("row")).join(cuts, "source").withColumn("copies", _copies(most))
    repeated = rows.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")
