"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio of trusted text against all text.

Byte n-grams are hashed into ``BUCKETS`` buckets. One pass counts them over the whole corpus and over trusted rows (a
bounded, documented sample: the ``TRUSTED`` labelled good rows with the smallest id hash); both counts become smoothed
multinomials. A text's score is the mean over its n-grams of log p(trusted) - log p(corpus), so it doesn't depend on
its length. A text is kept if the base rules pass and its score is at least ``THRESHOLD``, the same for every text.

Null or empty texts have no words, so the base rules fail. Without trusted rows all scores are 0, and the base rules
alone decide. Rows are independent; copies, ties and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import WHITE, byte_table, documents, in_text, owner, per_text, pieces, smallest_hashes, span_hashes, spans, text_bytes, whole_windows, window_hashes

BUCKETS = 1 << 16
NGRAM = 4
TRUSTED = 20_000
THRESHOLD = -0.35
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text; windows and lines are compared by 64-bit hashes."""
    n = len(bounds) - 1
    word = ~byte_table(WHITE)[data]
    starts, ends, first = spans(word, bounds)
    text = owner(first)
    out = {
        "n_words": np.diff(first),
        "word_chars": per_text(word & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": per_text(byte_table(SYMBOLS)[data], bounds),
    }
    line_starts, line_ends, line_first = spans(data != 10, bounds)
    has_word = np.concatenate(([0], np.cumsum(word)))
    worded = has_word[line_ends] > has_word[line_starts]
    line_text = owner(line_first)[worded]
    keys = in_text(span_hashes(data, line_starts[worded], line_ends[worded], seed=3), line_text)
    _, one_each = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(line_text, minlength=n) - np.bincount(line_text[one_each], minlength=n)
    windows = whole_windows(first, 5)
    repeated = np.zeros(0, np.int64)
    if len(windows):
        keys = in_text(window_hashes(span_hashes(data, starts, ends), 5)[windows], text[windows])
        _, group, times = np.unique(keys, return_inverse=True, return_counts=True)
        repeated = windows[times[group] > 1]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + 5, -1)
    out["n_repeat_words"] = per_text(np.cumsum(cover)[:-1] > 0, first)
    return {k: v.astype(np.int64) for k, v in out.items()}


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and whether it lies inside one text."""
    n = len(data) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    value = np.zeros(n, np.uint32)
    for k in range(NGRAM):
        value = (value << np.uint32(8)) | data[k : n + k]
    value *= np.uint32(2654435761)
    inside = np.ones(n + NGRAM, bool)
    for k in range(1, NGRAM):
        cut = bounds[1:] - k
        inside[cut[cut >= 0]] = False
    return (value >> np.uint32(16)).astype(np.int64), inside[:n]


def log_ratio(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> np.ndarray:
    """log p(trusted) - log p(corpus) of each bucket, from one pass over all documents."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    ids = np.sort(np.array([r[0] for r in smallest_hashes(good, trusted).collect()], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for piece in pieces(batches):
            data, bounds = text_bytes(piece.column("text"))
            bucket, inside = grams(data, bounds)
            raw += np.bincount(bucket[inside], minlength=BUCKETS)
            doc_id = piece.column("doc_id")
            chosen = np.isin(doc_id.fill_null(0).to_numpy(zero_copy_only=False), ids) & doc_id.is_valid().to_numpy(zero_copy_only=False)
            inside &= np.repeat(chosen, np.diff(bounds))[: len(inside)]
            target += np.bincount(bucket[inside], minlength=BUCKETS)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw[full]), pa.array(target[full])], ["bucket", "raw", "target"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "bucket long, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # one per bucket at most
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, r, t in rows:
        raw[bucket] += r
        target[bucket] += t
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def judged(data: np.ndarray, bounds: np.ndarray, ratio: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """Base counts, score and verdict of each text."""
    out = base_counts(data, bounds)
    bucket, inside = grams(data, bounds)
    gain = np.zeros(len(data))
    gain[: len(bucket)] = np.where(inside, ratio[bucket], 0.0)
    whole = np.zeros(len(data), bool)
    whole[: len(inside)] = inside
    sums = np.add.reduceat(np.append(gain, 0.0), bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    count = per_text(whole, bounds)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out["score"] = np.where(count > 0, sums / np.maximum(count, 1), 0.0)
    out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts, score, verdict."""
    ratio = log_ratio(docs, labels)
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = judged(*text_bytes(piece.column("text")), ratio, threshold)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), *(pa.array(out[k]) for k in names)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns."""
    ratio = log_ratio(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield piece.filter(pa.array(judged(*text_bytes(piece.column("text")), ratio, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
