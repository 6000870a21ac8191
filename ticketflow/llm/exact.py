"""Exact duplicates, by merging sorted runs of digests in rounds.

Every row gives a record: digest, length, a second hash, a count of one and its id. A run is what one task wrote, sorted by
digest. In a round, `fan` neighbouring runs go to one receiver, which merges equal
records and keeps one identifier, so a group of copies is never larger than the
number of runs of the round before. Records are dealt out by (receiver, digest),
so no round has a task for all records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.llm import tables

#: Runs that one receiver merges. Every round moves all distinct records once: with 2 there would be
#: four times as many rounds (14 instead of 4 for 10,000 tasks) for the same result.
FAN = 16

KEY = ["digest", "bytes", "proof"]


def records(docs: DataFrame) -> DataFrame:
    """One narrow row per row of docs: row, id, and the key of its text.

    A text is its digest, its length and a second, independent hash: two texts
    that share a digest but differ in the others stay apart.
    """
    text = tables.text_of()
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("bytes"),
        F.xxhash64(text).alias("proof"),
    )


def sorted_runs(docs: DataFrame) -> DataFrame:
    """The records, written with `run`, the number of the task that wrote them, each run in the order of its keys."""
    return tables.stored_runs(records(docs).sortWithinPartitions(*KEY), "digests")


def _merged(run: Column, runs: DataFrame, n: Column, keep: Column) -> DataFrame:
    return runs.groupBy(run.alias("run"), *KEY).agg(n.alias("n"), keep.alias("keep"))


def merge_runs(rows: DataFrame, fan: int = FAN, largest: bool = True) -> DataFrame:
    """rows of sorted_runs to one record per distinct text: its key, n and keep(id, row), the row that stays.

    The row with the largest id stays (or the smallest); of repeated rows with one
    id, one. Null ids come last in either order.
    """
    best = F.max if largest else F.min
    claim = F.struct(F.col("id").isNull() if not largest else F.col("id").isNotNull(), "id", "row")
    runs = 1 + (rows.agg(F.max("run")).first()[0] or 0)
    level, n, keep = rows, F.count(F.lit(1)), best(claim)
    while True:
        runs = -(-runs // fan)
        level = _merged(F.floor(F.col("run") / fan), level, n, keep)
        if runs == 1:
            return level.drop("run")
        n, keep = F.sum("n"), best("keep")


def exact_groups(docs: DataFrame, fan: int = FAN, largest: bool = True) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Repeated rows are copies of each other: one of them
    is kept. An empty table gives an empty result. Other columns are not read.
    """
    rows = sorted_runs(docs)
    groups = merge_runs(rows, fan, largest)
    joined = rows.join(groups, KEY)
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, fan: int = FAN, largest: bool = True) -> DataFrame:
    """docs with one row of each distinct text, in all its columns.

    Only ids and digests are merged; texts move once, dealt out by id and digest. Null and empty texts are one text;
    an empty table gives an empty one.
    """
    rows = sorted_runs(docs)
    groups = merge_runs(rows, fan, largest)
    kept = tables.stored(groups.select(F.col("keep.id").alias("id"), "digest"), "kept")
    repeated = rows.groupBy("id", "digest").count().filter("count > 1").limit(1).count() > 0

    texts = docs.select(
        F.struct(*docs.columns).alias("doc"), F.unhex(F.sha2(tables.text_of(), 256)).alias("digest")
    )
    here = texts["doc.doc_id"].eqNullSafe(kept["id"]) & (texts["digest"] == kept["digest"])
    left = texts.join(kept, here, "left_semi")
    if repeated:  # combined before the shuffle, so one id with a third of the rows is one row per task
        left = left.groupBy(F.col("doc.doc_id").alias("id"), "digest").agg(F.any_value("doc").alias("doc"))
    return left.select("doc.*")
