"""Tables that are replaced as a whole, or a partition at a time, while others read them.

A version of a table is a folder of its own below the table's folder, and a small numbered commit file, written last
and put in place by one rename that never replaces, says which folders make up the table from then on. So a reader
sees one whole version, a writer that is killed leaves the table as it was, a plan may replace the table that it
reads, and of two writers one comes after the other.

    table/version=000001-<id>/FechaFoto=2022-05-01/part-….parquet
    table/version=000002-<id>/FechaFoto=2022-06-01/part-….parquet
    table/_commits/000001.json      the whole table as of version 1
    table/_commits/000002.json      the partitions of version 1, one of them replaced

Folders that no kept commit names are removed by ``clean`` once they are old enough not to belong to a running writer.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from foliospark.sources.io import gathered_by

COMMITS, FOLDER = "_commits", "version"
WHOLE = ""  # the part of a table without partitions
GRACE = 24 * 3600


class Conflict(RuntimeError):
    """The table has a newer version than the one that a commit is based on."""


@dataclass(frozen=True)
class Version:
    """A committed version: the folder of each partition (one part without partitions), relative to the table's folder."""

    number: int
    schema: StructType
    partition_by: str | None
    parts: Mapping[str, str]
    source: Mapping[str, str] = field(default_factory=dict)  # what the parts were made from, for tables derived from others

    def text(self) -> str:
        told = {"schema": json.loads(self.schema.json()), "partition_by": self.partition_by, "parts": dict(self.parts), "source": dict(self.source)}
        return json.dumps(told, sort_keys=True)

    @staticmethod
    def parse(number: int, text: str) -> Version:
        told = json.loads(text)
        return Version(number, StructType.fromJson(told["schema"]), told["partition_by"], told["parts"], told["source"])


class _Files:
    """The file system of a table, through Hadoop, so that any store that Spark reaches will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.path().getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), conf)
        none = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        self.rename = spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        self.rename[0] = none

    def path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def children(self, *names: str) -> list[tuple[str, float]]:
        """Names and times (seconds) of what a folder holds; none if there is no such folder."""
        try:
            found = self.system.listStatus(self.path(*names))
        except Py4JJavaError as error:
            if "FileNotFoundException" in str(error.java_exception):
                return []
            raise
        return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in found]

    def text(self, *names: str) -> str:
        stream = self.system.open(self.path(*names))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, text: str, *names: str) -> bool:
        """Writes a file that nobody sees before it is whole; False if it is there already."""
        draft = self.path(*names[:-1], f".{names[-1]}.{uuid.uuid4().hex}")
        self.system.mkdirs(draft.getParent())
        out = self.system.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self.context.rename(draft, self.path(*names), self.rename)
        except Py4JJavaError as error:
            self.system.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def delete(self, *names: str) -> None:
        self.system.delete(self.path(*names), True)


def _numbers(files: _Files) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n, _ in files.children(COMMITS) if n.endswith(".json") and not n.startswith("."))


def current(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest version of a table, or the one of a number; None if there is none yet."""
    files = _Files(spark, path)
    numbers = _numbers(files)
    if number is None:
        number = numbers[-1] if numbers else None
    if number is None or number not in numbers:
        return None
    return Version.parse(number, files.text(COMMITS, f"{number:06d}.json"))


def read_published(spark: SparkSession, path: str, number: int | None = None, only: Collection[str] | None = None) -> DataFrame:
    """The table as of its newest version (or a number), whatever writers do meanwhile.

    ``only`` names partitions: other folders are not even listed.
    """
    version = current(spark, path, number)
    if version is None:
        raise FileNotFoundError(f"{path} has no version {'' if number is None else number}".rstrip())
    root = path.rstrip("/")
    folders = [f"{root}/{folder}" for part, folder in sorted(version.parts.items()) if only is None or part in only]
    if not folders:
        return spark.createDataFrame([], version.schema)
    schema = StructType([*version.schema.fields]).add(FOLDER, "string")
    rows = spark.read.schema(schema).option("basePath", root).parquet(*folders)
    return rows.select(*version.schema.names)


def _write(df: DataFrame, path: str, partition_by: str | None, files: _Files) -> dict[str, str]:
    """Writes a new folder, and returns the folder of each of its partitions."""
    if FOLDER in (c.lower() for c in df.columns):
        raise ValueError(f"a published table can't have a column {FOLDER!r}")
    folder = f"{FOLDER}={(_numbers(files) or [0])[-1] + 1:06d}-{uuid.uuid4().hex}"
    target = f"{path.rstrip('/')}/{folder}"
    if partition_by is None:
        df.write.parquet(target)
        return {WHOLE: folder}
    gathered_by(df, partition_by).write.partitionBy(partition_by).parquet(target)
    return {n.split("=", 1)[1]: f"{folder}/{n}" for n, _ in files.children(folder) if n.startswith(partition_by + "=")}


def _commit(files: _Files, version: Version) -> bool:
    return files.put(version.text(), COMMITS, f"{version.number:06d}.json")


def publish(df: DataFrame, path: str, partition_by: str | None = None, source: Mapping[str, str] | None = None) -> Version:
    """Replaces the table by ``df``, which may read it. Of several writers at once the last one to commit is seen."""
    files = _Files(df.sparkSession, path)
    parts = _write(df, path, partition_by, files)
    while True:
        number = (_numbers(files) or [0])[-1] + 1
        version = Version(number, df.schema, partition_by, parts, source or {})
        if _commit(files, version):
            return version


def publish_partitions(
    df: DataFrame, path: str, partition_by: str, emptied: Collection[str] = (), source: Mapping[str, str] | None = None, based_on: int | None = None,
) -> Version:
    """Replaces those partitions of the table that ``df`` has rows of, and takes away those of ``emptied`` that it has none of.

    The others keep their files. Writers of different partitions don't disturb each other; ``based_on`` refuses to commit
    over any version but that one. ``source`` is told for the parts written or taken away; others keep what they have.
    """
    spark = df.sparkSession
    files = _Files(spark, path)
    parts = _write(df, path, partition_by, files)
    while True:
        last = current(spark, path)
        number = 0 if last is None else last.number
        if based_on is not None and number != based_on:
            raise Conflict(f"{path} is at version {number}, not {based_on}")
        if last is not None and (last.partition_by != partition_by or last.schema.simpleString() != df.schema.simpleString()):
            raise ValueError(f"{path} is partitioned by {last.partition_by}: {last.schema.simpleString()}")
        replaced = {*emptied, *parts}
        kept = {p: f for p, f in (last.parts if last else {}).items() if p not in replaced}
        sources = {p: s for p, s in (last.source if last else {}).items() if p not in replaced}
        version = Version(number + 1, df.schema if last is None else last.schema, partition_by, kept | parts, sources | dict(source or {}))
        if _commit(files, version):
            return version


def clean(spark: SparkSession, path: str, keep: int = 2, grace: float = GRACE) -> list[str]:
    """Removes commits but the last ``keep``, and folders that none of those names and that are older than ``grace`` seconds.

    Returns the folders removed. A folder without a commit may belong to a running writer, so ``grace`` is to be longer
    than any job; drafts of commits go the same way.
    """
    files = _Files(spark, path)
    numbers = _numbers(files)
    held = [current(spark, path, n) for n in numbers[-keep:]] if keep else []
    for n in numbers[: len(numbers) - len(held)]:
        files.delete(COMMITS, f"{n:06d}.json")
    named = {f.split("/")[0] for v in held if v for f in v.parts.values()}
    now = time.time()
    old = [n for n, when in files.children() if n.startswith(FOLDER + "=") and n not in named and now - when >= grace]
    for n in old:
        files.delete(n)
    for n, when in files.children(COMMITS):
        if n.startswith(".") and not n.endswith(".crc") and now - when >= grace:
            files.delete(COMMITS, n)
    return sorted(old)
