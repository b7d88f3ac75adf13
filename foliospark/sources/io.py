"""Parquet sources and sinks."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.dates import date_lit


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def snapshots(df: DataFrame, column: str, dates: Sequence[dt.date]) -> DataFrame:
    """Rows of the listed snapshot dates (a pushed-down, partition-prunable filter)."""
    return df.filter(F.col(column).isin(*[F.lit(d) for d in dates]))


def date_range(df: DataFrame, column: str, first: str | None = None, last: str | None = None, before: str | None = None) -> DataFrame:
    """Rows dated from ``first`` on, up to ``last`` (included) or ``before`` (excluded)."""
    if first is not None:
        df = df.filter(F.col(column) >= date_lit(first))
    if last is not None:
        df = df.filter(F.col(column) <= date_lit(last))
    if before is not None:
        df = df.filter(F.col(column) < date_lit(before))
    return df


def gathered_by(df: DataFrame, column: str) -> DataFrame:
    """Rows gathered by the value of a partition column; a large value is split by its size in bytes."""
    return df.hint("rebalance", column)


def write_replace(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replaces a folder that nothing reads meanwhile; tables that others read are published (``sources/published.py``)."""
    if partition_by is None:
        df.write.mode("overwrite").parquet(path)
        return
    gathered_by(df, partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or one beside the tables of the warehouse.

    On a cluster a warehouse on the driver's own disk is no such folder, and an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not on_one_machine(spark.sparkContext.master) and _scheme(spark, warehouse) == "file":
        raise ValueError(f"spark.checkpoint.dir is not set, and {warehouse} is a folder of one machine")
    return warehouse + "/_work"


def on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def _scheme(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()


_run: ContextVar[str] = ContextVar("run", default="")
#: Catalog names of bucketed tables, by the folder that holds their files.
_tables: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for what is stored inside the block; removed at its end, so results must be written by then."""
    path = f"{shared_folder(spark)}/foliospark/{uuid.uuid4().hex}"
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        _forget(spark, path)


def stored_folder(spark: SparkSession) -> str:
    """Where intermediates go: the folder of the run, or, outside of one, a folder named after the application."""
    return _run.get() or f"{shared_folder(spark)}/foliospark/{spark.sparkContext.applicationId}"


def _forget(spark: SparkSession, base: str) -> None:
    """Removes what was stored under a folder, and its names."""
    for name in _tables.pop(base, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _delete(spark, base)


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate that several steps read and returns the stored table.

    It outlives lost executors, cuts the plan, keeps column pruning for each reader and
    gives the optimizer its true size for join choices. It goes to the folder of the run,
    or, outside of one, to a folder named after the application.
    """
    spark = df.sparkSession
    path = f"{stored_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, column: str, buckets: int, dealt: bool = False) -> DataFrame:
    """``store`` in buckets by a column: tables with the same number of buckets join and group by it without a shuffle.

    Rows are dealt to one task per bucket first, unless ``df`` is ``dealt`` so already; then each bucket is one file. The
    table has a name of its own in the session's catalog, as Spark keeps the bucketing there, and its files where ``store``
    puts them; both go when the run ends.
    """
    spark = df.sparkSession
    base = stored_folder(spark)
    ident = uuid.uuid4().hex
    table = f"spark_catalog.default.foliospark_{name}_{ident}"
    rows = df if dealt else df.repartition(buckets, column)
    rows.write.bucketBy(buckets, column).option("path", f"{base}/{ident}/{name}").format("parquet").saveAsTable(table)
    _tables.setdefault(base, []).append(table)
    return spark.table(table)


def dealt_by(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Rows of a value in one task, in as many tasks as stored ``buckets``; nothing moves if they lie so already. 0: as they are."""
    return df.repartition(buckets, column) if buckets else df


def store_partitioned(df: DataFrame, name: str, column: str) -> str:
    """``store`` in partitions by a column, as a catalog table that goes when the run ends; its name of three parts."""
    base = stored_folder(df.sparkSession)
    ident = uuid.uuid4().hex
    table = f"spark_catalog.default.foliospark_{name}_{ident}"
    gathered_by(df, column).write.partitionBy(column).option("path", f"{base}/{ident}/{name}").format("parquet").saveAsTable(table)
    _tables.setdefault(base, []).append(table)
    return table


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Inside the block, joins on more columns than those that both sides are dealt by need no shuffle either.

    That is Spark's choice against skew, which doesn't matter where the columns dealt by bound a key's rows by themselves.
    Plans are made when they run, so what is asked for must run inside the block.
    """
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove_stored(spark: SparkSession) -> None:
    """Removes what this application has stored outside of a run folder."""
    _forget(spark, f"{shared_folder(spark)}/foliospark/{spark.sparkContext.applicationId}")
