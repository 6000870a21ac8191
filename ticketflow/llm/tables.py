"""Reading input tables, and tables written between two steps of an operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketflow.session import shared_folder

#: What separates words, and the letters that are lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written below spark.checkpoint.dir and read again: a cut in the lineage
    that outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_runs(df: DataFrame, name: str) -> DataFrame:
    """As stored, with `run`: the number of the task that wrote the row."""
    return stored(df.withColumn("run", F.spark_partition_id()), name)


def ranked(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows of stored_runs with `name`: 0, 1, ... among those of one `by`.

    Rows are numbered by run and then in the given order; what differs in none of its columns may be numbered either way. However many rows
    share a value, or all their columns, a task orders only those that one task wrote.
    """
    counted = rows.groupBy(by, "run").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select(by, "run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy(by, "run").orderBy(*order))
    numbered = rows.withColumn("_nth", nth).join(base, [by, "run"])
    return numbered.withColumn(name, F.col("_base") + F.col("_nth") - 1).drop("_base", "_nth", "run")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest_of(column: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(column), 256))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each root of groups(id, digest, root), in the columns of docs: the smallest id, null last,
    and of those the smallest digest; of rows that repeat both, one."""
    claim = F.struct(F.col("id").isNull(), "id", "digest")
    kept = stored(groups.groupBy("root").agg(F.min(claim).alias("keep")).select("keep.id", "keep.digest"), "kept")
    repeated = groups.groupBy("id", "digest").count().filter("count > 1").limit(1).count() > 0
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest_of().alias("hash"))
    here = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("digest"))
    left = rows.join(kept, here, "left_semi")
    if repeated:
        left = left.groupBy(F.col("row.doc_id").alias("id"), "hash").agg(F.any_value("row").alias("row"))
    return left.select("row.*")
