"""Vocabulary, token ids, padding by batch, and batched maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.fixed_values import MAX_LENGTH, PAD, RESERVED_TOKENS, UNK
from ticketflow.functions import text as tx
from ticketflow.operators.rank import bucket, bucket_bounds

LOOKUP_BUCKETS = 4_096
#: Entries of a vocabulary that is sent to the tasks as one value, at most.
LOOKUP_LIMIT = 1 << 20


def tokenize(df: DataFrame, col: str = "text", name: str = "tokens") -> DataFrame:
    return df.withColumn(name, tx.tokens(col))


def encode_fixed(df: DataFrame, col: str = "text", max_length: int = MAX_LENGTH) -> DataFrame:
    """Add ``tokens`` of exactly ``max_length`` entries and their ``mask``."""
    return (
        df.withColumn("tokens", tx.truncate(tx.tokens(col), max_length))
        .withColumn("mask", tx.attention_mask("tokens", max_length))
        .withColumn("tokens", tx.pad("tokens", max_length))
    )


def pad_batch(df: DataFrame, batch: str = "batch_id", tokens: str = "tokens") -> DataFrame:
    """Pad ``tokens`` to the longest of the row's batch and add ``mask``.

    Truncate first: then what moves to group a batch is bounded per row. Rows
    without a batch are one batch.
    """
    longest = df.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.size(tokens)).alias("_longest"))
    return (
        df.join(longest, F.col(batch).eqNullSafe(F.col("_batch")))
        .withColumn("mask", tx.attention_mask(tokens, F.col("_longest")))
        .withColumn(tokens, tx.pad(tokens, F.col("_longest")))
        .drop("_longest", "_batch")
    )


def build_vocabulary(df: DataFrame, size: int | None = None, tokens: str = "tokens") -> DataFrame:
    """``token, token_id`` of all tokens, or of the ``size`` most frequent ones;
    ties by the md5 of the token.

    Counts combine before the shuffle, so a token that is everywhere is cheap.
    An id is the number of more frequent tokens plus the rank among those of
    one count, which is found bucket by bucket: no task ranks all tokens.
    """
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    keyed = counts.withColumn("_h", F.md5("token")).withColumn("_bucket", bucket(F.col("_h")))
    # one row per distinct count: at most the square root of twice the tokens
    more = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    above = keyed.groupBy("n").agg(F.count("*").alias("_same"))
    above = above.select("n", F.coalesce(F.sum("_same").over(more), F.lit(0)).alias("_above"))
    bounds = bucket_bounds(keyed.select("n", "_bucket"), by=["n"]).drop("_size")
    within = Window.partitionBy("n", "_bucket").orderBy("_h", "token")
    place = F.col("_above") + F.col("_below") + F.row_number().over(within) - 1
    ranked = keyed.join(bounds, ["n", "_bucket"]).join(above, "n").select("token", place.alias("_i"))
    if size is not None:
        ranked = ranked.filter(F.col("_i") < size)
    return ranked.select("token", (F.col("_i") + len(RESERVED_TOKENS)).cast("int").alias("token_id"))


def used_vocabulary(vocabulary: DataFrame, df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The entries of ``vocabulary`` whose token occurs in ``df``, with the ids they have in the whole.

    For few rows and a vocabulary too large for token_ids(). ``df`` is read for its distinct tokens, so it must be a
    table that gives the same rows when it is read again.
    """
    return vocabulary.join(df.select(F.explode(tokens).alias("token")).distinct(), "token", "left_semi")


def _lookup(vocabulary: DataFrame, limit: int) -> Column:
    """The vocabulary as one value: an array of small maps, found by token
    hash. It is computed once per query and sent to the tasks, so encoding
    needs neither a shuffle nor Python. One entry beyond ``limit`` is an error, and no more are gathered."""
    spark = vocabulary.sparkSession
    reserved = F.create_map(*[F.lit(x) for i, t in enumerate(RESERVED_TOKENS) for x in (t, i)])
    reserved = spark.range(1).select(F.explode(reserved).alias("token", "token_id"))
    entries = vocabulary.select("token", "token_id").limit(limit + 1).unionByName(reserved)
    grouped = entries.groupBy(_slot(F.col("token")).alias("_slot")).agg(
        F.collect_list(F.struct("token", "token_id")).alias("_entries")
    )
    slots = spark.range(LOOKUP_BUCKETS).select(F.col("id").cast("int").alias("_slot"))
    dense = slots.join(grouped, "_slot", "left").select(
        F.struct("_slot", F.coalesce("_entries", F.array().cast(grouped.schema["_entries"].dataType)).alias("e")).alias("_s")
    )
    maps = F.transform(F.array_sort(F.collect_list("_s")), lambda s: F.map_from_entries(s["e"]))
    refused = F.raise_error(F.lit(f"a vocabulary that exceeds {limit} entries; use used_vocabulary() or joined_token_ids()"))
    kind = f"array<map<string,{vocabulary.schema['token_id'].dataType.simpleString()}>>"
    entered = F.sum(F.size("_s.e")) - len(RESERVED_TOKENS)
    return dense.agg(F.when(entered > limit, refused.cast(kind)).otherwise(maps)).scalar()


def _slot(token: Column) -> Column:
    return F.pmod(F.hash(token), F.lit(LOOKUP_BUCKETS)).cast("int")


def token_ids(
    df: DataFrame, vocabulary: DataFrame, tokens: str = "tokens", name: str = "ids", limit: int = LOOKUP_LIMIT
) -> DataFrame:
    """Add the id array of a token array; a token outside the vocabulary gets
    the unknown id.

    For a vocabulary of a model's size: it is gathered into one value, and no
    row is shuffled. A vocabulary of more than ``limit`` entries fails the query before more are gathered.
    used_vocabulary() leaves the entries that few rows need; joined_token_ids() gives the same for any size.
    """
    unknown = F.lit(RESERVED_TOKENS.index(UNK))
    table = _lookup(vocabulary, limit)
    ids = F.transform(
        F.col(tokens), lambda t: F.coalesce(F.try_element_at(F.get(F.col("_table"), _slot(t)), t), unknown)
    )
    return df.withColumn("_table", table).withColumn(name, ids).drop("_table")


def joined_token_ids(
    df: DataFrame, vocabulary: DataFrame, key: Sequence[str], tokens: str = "tokens", name: str = "ids"
) -> DataFrame:
    """token_ids() by a join, for a vocabulary of any size.

    ``key`` names columns that identify a row and hold no null. Each distinct
    token of a row meets the vocabulary once; its ids come back as one map.
    """
    words = df.select(*key, F.explode(F.array_distinct(tokens)).alias("token"))
    reserved = F.create_map(*[F.lit(x) for i, t in enumerate(RESERVED_TOKENS) for x in (t, i)])
    known = vocabulary.select("token", "token_id").unionByName(
        df.sparkSession.range(1).select(F.explode(reserved).alias("token", "token_id"))
    )
    pairs = words.join(known, "token").groupBy(*key).agg(F.collect_list(F.struct("token", "token_id")).alias("_pairs"))
    found = pairs.select(*key, F.map_from_entries("_pairs").alias("_ids"))
    unknown = F.lit(RESERVED_TOKENS.index(UNK))
    ids = F.transform(F.col(tokens), lambda t: F.coalesce(F.try_element_at(F.col("_ids"), t), unknown))
    return df.join(found, list(key), "left").withColumn(name, ids).drop("_ids")


def pad_ids(ids: str | Column, length: int) -> Column:
    return tx.pad(ids, length, RESERVED_TOKENS.index(PAD))


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_size: int | None = None
) -> DataFrame:
    """Apply ``fn`` to pandas batches of the table, at most ``batch_size``
    rows each. For what built-in functions cannot express."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = batch_size or max(len(batch), 1)
            for start in range(0, len(batch), step):
                yield fn(batch.iloc[start : start + step])

    return df.mapInPandas(run, schema)
