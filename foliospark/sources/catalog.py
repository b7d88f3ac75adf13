"""Inputs by catalog name, and snapshot lists that prune partitions of catalog tables.

A job asks for its inputs by their short names; ``catalog_inputs`` looks them up as ``catalog.schema.table`` and gives
them the declared columns and types. Filters on a partition column decide which partitions are listed at all: a list of
dates and a month-end test do so when the query is planned, a joined list of dates while it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.inputs import INPUTS, conform
from foliospark.sources.io import gathered_by

#: A joined list of snapshot dates has no more rows than a calendar has days in some centuries.
MOST_DATES = 100_000


def qualified(name: str) -> str:
    """A name of three parts, checked; each part is quoted, so that it may hold any character but a dot."""
    parts = name.split(".")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"{name!r} is not catalog.schema.table")
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(qualified(name))


def catalog_inputs(
    spark: SparkSession, tables: str | Mapping[str, str], columns: Mapping[str, Mapping[str, str]] | None = None,
) -> Callable[[str], DataFrame]:
    """The inputs of the jobs by short name: ``tables`` is ``catalog.schema``, or says the full name of each input.

    ``columns`` maps, for an input, declared column names to those that the table has where they differ.
    """

    def table(name: str) -> DataFrame:
        if name not in INPUTS:
            raise KeyError(f"{name} is no input")
        full = f"{tables}.{name}" if isinstance(tables, str) else tables[name]
        return conform(read_table(spark, full), name, (columns or {}).get(name))

    return table


def write_table(df: DataFrame, name: str, partition_by: str | None = None, path: str | None = None) -> None:
    """Creates or replaces a catalog table, in partitions by a column if one is given, at a path if one is given."""
    rows = gathered_by(df, partition_by) if partition_by else df
    writer = rows.write.mode("overwrite").format("parquet")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer = writer.option("path", path) if path else writer
    writer.saveAsTable(qualified(name))


def snapshots_listed(df: DataFrame, column: str, dates: DataFrame, date: str) -> DataFrame:
    """The rows of snapshot dates that stand in a table of dates, once each however often a date stands there.

    The list goes to every task, so where ``column`` partitions ``df`` only the listed partitions are read. A list of more
    than ``MOST_DATES`` different dates is no list of snapshots and an error.
    """
    listed = dates.select(F.col(date).alias("__date")).filter(F.col("__date").isNotNull()).distinct()
    if listed.limit(MOST_DATES + 1).count() > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} snapshot dates")
    return df.join(F.broadcast(listed), F.col(column) == F.col("__date"), "inner").drop("__date")
