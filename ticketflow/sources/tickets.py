"""Ticket tables, splits and scored tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.fixed_values import DEMO_TEXTS, NEW_EXAMPLES
from ticketflow.schema import SCORED, TICKET
from ticketflow.session import written

# Quotes are doubled and may enclose line breaks.
CSV_READ = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}
CSV_WRITE = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# A CSV file with quoted line breaks is read by one task, so files stay small.
CSV_ROWS_PER_FILE = 1_000_000
# The row as it stands in the file, where the schema refuses it.
REFUSED = "_refused"


def read_tickets(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    schema: T.StructType = TICKET,
    multi_line: bool = True,
    strict: bool = False,
) -> DataFrame:
    """A labelled table from CSV, Parquet, JSON or ORC, with the schema given
    and not guessed. A list of paths reads several files as one table.

    A CSV file with quoted line breaks is read by one task; without them, say
    ``multi_line=False``, and a large file is read in parts.

    What the schema refuses in a row of CSV or JSON is null; with ``strict`` the read fails
    there, or where a CSV header has other names. read_checked() tells such rows apart.
    """
    reader = _reader(spark, fmt, schema, multi_line)
    if strict:
        reader = reader.option("mode", "FAILFAST").options(**CSV_WHOLE).option("enforceSchema", False)
    return reader.load(path)


# All columns are parsed, whichever a query asks for: else a row is refused by one query and not by the next.
CSV_WHOLE = {"columnPruning": "false"}


def _reader(spark: SparkSession, fmt: str, schema: T.StructType, multi_line: bool):
    reader = spark.read.schema(schema).format(fmt)
    return reader.options(**CSV_READ).option("multiLine", multi_line) if fmt == "csv" else reader


def read_checked(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    schema: T.StructType = TICKET,
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """A table from CSV or JSON as (rows that fit the schema, rows that it refuses).

    A row is refused that has a value of another type, or too few or too many of them. The refused have the
    values that fit, the others null, and ``_refused``, the row as it stands in the file. The files are parsed once,
    into a table in the shared folder, from which both are read.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"{fmt} has its own schema; read_tickets() fails where it differs")
    marked = T.StructType([*schema.fields, T.StructField(REFUSED, T.StringType())])
    reader = _reader(spark, fmt, marked, multi_line).options(**CSV_WHOLE)
    rows = written(reader.option("columnNameOfCorruptRecord", REFUSED).load(path), "checked")
    return rows.filter(F.col(REFUSED).isNull()).drop(REFUSED), rows.filter(F.col(REFUSED).isNotNull())


def _writer(df: DataFrame, fmt: str):
    writer = df.write.format(fmt).mode("overwrite")
    if fmt == "csv":
        writer = writer.options(**CSV_WRITE).option("maxRecordsPerFile", CSV_ROWS_PER_FILE)
    return writer


def write_tickets(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _writer(df, fmt).save(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", split: str = "split") -> None:
    """One table with a folder per split; reading one split opens one folder."""
    _writer(df, fmt).partitionBy(split).save(path)


def read_split(
    spark: SparkSession,
    path: str,
    name: str,
    fmt: str = "parquet",
    schema: T.StructType = TICKET,
    split: str = "split",
) -> DataFrame:
    with_split = T.StructType([*schema.fields, T.StructField(split, T.StringType())])
    return read_tickets(spark, path, fmt, with_split).filter(F.col(split) == name).drop(split)


def write_scored(df: DataFrame, path: str, fmt: str = "csv") -> None:
    write_tickets(df, path, fmt)


def read_scored(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = SCORED) -> DataFrame:
    return read_tickets(spark, path, fmt, schema)


def write_routed(df: DataFrame, path: str, fmt: str = "parquet", decision: str = "decision") -> None:
    """Scored rows in a folder per decision: handled rows and a review queue."""
    write_splits(df, path, fmt, decision)


def inline_examples(spark: SparkSession) -> DataFrame:
    """Ten labelled texts that were not generated: ``text, expected``."""
    return spark.createDataFrame(list(NEW_EXAMPLES), "text string, expected string")


def demo_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in DEMO_TEXTS], "text string")
