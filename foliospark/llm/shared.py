"""Helpers of the text operators: stored intermediates, Arrow text batches, word spans and their hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.io import stored_folder

WHITE = bytes([0x20, *range(0x09, 0x0E)])
PIECE = 1_000_000
BITS = 23
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch:
    """Written tables of one operator run, under one folder of the shared place.

    Results read them, so they stay until the run folder around them ends or ``remove_stored`` is called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{stored_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def store(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again: cuts the lineage, survives lost executors, and lets Spark delete the shuffle
        files of the job as soon as the table is written."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, stored: DataFrame) -> None:
        """Delete a table of ``store`` that nothing will read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(stored._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def smallest_hashes(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows: those whose doc_id has the smallest hashes. A limit on the hash that lets about twice as many
    through comes first, so that a task hands on few rows, however many tasks there are."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    limit = min(1.0, 2 * (most + 100) / max(rows.count(), 1)) * (1 << 40)
    return rows.filter(place < F.lit(int(limit))).orderBy(place, *rows.columns).limit(most)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 places where they begin; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    bounds = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``size`` bytes of text (one row at least), so that memory is bounded."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(first, last - first)
            first = last


def byte_table(inside: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(inside)] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spans(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``mask`` inside each text, and the n + 1 places where a text's runs begin."""
    near = np.zeros(len(mask) + 1, bool)
    near[1:] = mask if len(mask) else False
    near[bounds[:-1]] = False
    starts = np.flatnonzero(mask & ~near[:-1])
    near[:-1] = mask
    near[-1] = False
    near[bounds[1:]] = False
    ends = np.flatnonzero(mask & ~near[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def owner(first: np.ndarray) -> np.ndarray:
    """The index of the text of each run, from the places where the texts' runs begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans, by differences of one running polynomial sum."""
    base = 0x9E3779B97F4A7C15
    codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
    powers = np.full(len(data) + 1, base, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers[:-1], out=sums[1:])
    inverse = np.full(len(data) + 1, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(base))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` following values; there are ``len - width + 1``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, width):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += hashes[k : n + k]
    return mixed(total)


def whole_windows(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` words that lie inside one text."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    place = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return place + np.arange(counts.sum())


def in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The hashes, made different in different texts, so that one sort groups equal values of one text."""
    return mixed(hashes ^ mixed(text.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the stretch of each text."""
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def bit_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(1 << BITS))


class Bitmap:
    """A set of ids as a bitmap of fixed size: small enough for any task, and a few other ids seem to be in it."""

    def __init__(self, ids: DataFrame):
        bits = ids.select(bit_of(F.col(ids.columns[0])).alias("bit"))
        words = bits.groupBy(F.shiftright("bit", 6)).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))"))).collect()
        self.words = np.zeros(1 << (BITS - 6), np.uint64)
        for word, value in words:  # as many as the bitmap has words at most
            self.words[word] = np.int64(value).astype(np.uint64)

    def holds(self, bit: pa.Array) -> np.ndarray:
        """Whether each bit number is set; null is not."""
        known = bit.is_valid().to_numpy(zero_copy_only=False)
        at = bit.fill_null(0).to_numpy(zero_copy_only=False)
        return known & ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    def rows(self, docs: DataFrame, inside: bool) -> DataFrame:
        """The rows of ``docs`` whose doc_id seems to be in the set, or those whose doc_id is not (null is not)."""
        place = "bit_of_id_" + uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.drop_columns([place]).filter(pa.array(self.holds(batch.column(place)) == inside))

        bit = F.when(F.col("doc_id").isNotNull(), bit_of(F.col("doc_id")))
        return docs.withColumn(place, bit).mapInArrow(run, docs.schema)
