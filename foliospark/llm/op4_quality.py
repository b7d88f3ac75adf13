"""Quality scores: histogram gradient-boosted trees over document statistics.

One pass turns every whole text into a short row of statistics, which is stored. The trees are fitted on a bounded,
documented sample (the ``SAMPLE`` labelled learning rows with the smallest id hash): values become at most 64 bins by
their quantiles, each level of a tree adds up gradients per node, feature and bin, and takes the best split. The fitted
trees are flattened into arrays of feature, threshold, children and value, and every row walks all trees at once in
numpy.

Statistics of null and empty texts are all 0 and get a score like any other. Without learning rows, or with one label
only, the score is the smoothed share of label 1 (0.5 without rows). Labels that are null are left out; a document with
several label rows counts once for each. Extra columns change nothing, and neither label, lang, source nor doc_id is a
statistic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.op9_rules import base_counts
from foliospark.llm.shared import WHITE, Scratch, byte_table, documents, in_text, lower_table, owner, per_text, pieces, smallest_hashes, span_hashes, spans, text_bytes

SAMPLE = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
FEATURES = (
    "log_bytes", "log_words", "mean_word", "std_word", "upper", "digit", "non_ascii", "symbol", "bang", "bar", "stop_mark", "comma", "quote",
    "newline", "white", "dup_lines", "repeat_words", "distinct_words", "same_as_last", "symbol_ends", "capital_starts", "line_words", "sentence_words", "long_words",
)


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    base = base_counts(data, bounds)
    n, words = len(bounds) - 1, base["n_words"]
    size = np.diff(bounds)
    starts, ends, first = spans(~byte_table(WHITE)[data], bounds)
    text, length = owner(first), ends - starts
    hashes = span_hashes(lower_table()[data], starts, ends)
    _, one_each = np.unique(in_text(hashes, text), return_index=True)
    distinct = np.bincount(text[one_each], minlength=n)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    upper = byte_table(bytes(range(65, 91)))
    share = lambda table: per_text(table[data], bounds) / np.maximum(size, 1)
    by_word = lambda flag: per_text(flag, first) / np.maximum(words, 1)
    lines = per_text(data == 10, bounds) + 1
    stops = per_text(byte_table(b".!?")[data], bounds) + 1
    mean = by_word(length)
    columns = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(words), "mean_word": mean,
        "std_word": np.sqrt(np.maximum(by_word(length * length) - mean * mean, 0)),
        "upper": share(upper), "digit": share(byte_table(b"0123456789")), "non_ascii": share(byte_table(bytes(range(128, 256)))),
        "symbol": base["n_symbols"] / np.maximum(base["word_chars"], 1), "bang": share(byte_table(b"!")), "bar": share(byte_table(b"|")),
        "stop_mark": share(byte_table(b".")), "comma": share(byte_table(b",;:")), "quote": share(byte_table(b"\"'()[]{}=")),
        "newline": share(byte_table(b"\n")), "white": share(byte_table(WHITE)), "dup_lines": base["n_dup_lines"] / lines,
        "repeat_words": base["n_repeat_words"] / np.maximum(words, 1), "distinct_words": distinct / np.maximum(words, 1), "same_as_last": by_word(same),
        "symbol_ends": by_word(byte_table(b"#*$%&|<>!")[data[ends - 1]]), "capital_starts": by_word(upper[data[starts]]),
        "line_words": words / lines, "sentence_words": words / stops, "long_words": by_word(length > 12),
    }
    return np.column_stack([columns[x] for x in FEATURES]).astype(np.float64) if n else np.zeros((0, len(FEATURES)))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            values = statistics(*text_bytes(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), *(pa.array(values[:, k]) for k in range(len(FEATURES)))], ["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in FEATURES))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0, least: float = 2.0) -> dict[str, np.ndarray]:
    """Boosted trees for label 0 or 1, as flat arrays; node 2k + 1 and 2k + 2 are the children of node k."""
    rows, features = x.shape if x.ndim == 2 else (0, len(FEATURES))
    nodes = 2 ** (depth + 1) - 1
    model = {"feature": np.zeros((trees, nodes), np.int32), "threshold": np.full((trees, nodes), np.inf), "value": np.zeros((trees, nodes)), "base": np.zeros(1)}
    good = float(y.sum()) if rows else 0.0
    model["base"][0] = np.log((good + 0.5) / (rows - good + 0.5))
    if not rows or good in (0.0, float(rows)):
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(features)])  # value <= cut k: bin <= k
    margin = np.full(rows, model["base"][0])
    place = np.arange(features) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = p - y, p * (1 - p)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            low, count = 2**level - 1, 2**level
            slot = ((node - low)[:, None] * (features * bins) + place + binned).ravel()
            sums = [np.bincount(slot, np.repeat(v, features), count * features * bins).reshape(count, features, bins).cumsum(2) for v in (grad, curve)]
            g, h = sums
            total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            gain[(h < least) | (total_h - h < least)] = -np.inf
            for f in range(features):
                gain[:, f, len(cuts[f]) :] = -np.inf
            best = gain.reshape(count, -1).argmax(1)
            chosen, cut = best // bins, best % bins
            split = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            for k in np.flatnonzero(split):
                model["feature"][t, low + k] = chosen[k]
                model["threshold"][t, low + k] = cuts[chosen[k]][cut[k]]
            here = node - low
            right = np.where(split[here], binned[np.arange(rows), chosen[here]] > cut[here], False)
            node = 2 * node + 1 + right
        low = 2**depth - 1
        g, h = np.bincount(node - low, grad, 2**depth), np.bincount(node - low, curve, 2**depth)
        model["value"][t, low:] = -rate * g / (h + ridge)
        margin += model["value"][t, node]
    return model


def walk(model: dict[str, np.ndarray], x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Scores of the rows: all rows go down one tree together."""
    margin = np.full(len(x), model["base"][0])
    rows = np.arange(len(x))
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        margin += value[node]
    return 1 / (1 + np.exp(-margin))


def fold(column: str, parts: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: whether it was held out, its score, and the predicted label."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.store(document_statistics(docs))
    learn = labels.filter("quality is not null and doc_id is not null").filter(fold("doc_id", 3) != 1).select("doc_id", F.col("quality").cast("double").alias("label"))
    chosen = smallest_hashes(learn, sample)
    rows = stats.join(chosen, "doc_id").orderBy("doc_id", "label", *FEATURES).limit(2 * sample).toPandas()
    model = fit_trees(rows[list(FEATURES)].to_numpy(np.float64), rows["label"].to_numpy(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            score = walk(model, x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return stats.select("doc_id", held, *FEATURES).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
