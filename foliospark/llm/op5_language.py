"""Language identification: words first, then progressively shorter character n-grams for words never seen.

Learning counts the words of a bounded, documented sample of whole texts (about ``SAMPLE`` learning rows for each
language, those with the smallest id hashes) per language, in Spark, and from all those words the n-grams of 1 to
``LONGEST`` characters, with marks for word ends. Of words, and of n-grams of each length, a language knows its own most
frequent ones: about ``UNITS`` / the number of languages, so that the model has a fixed size and no language is crowded
out by others. A known word scores its smoothed log frequency in each language. Any other word backs off: from each of
its characters on, the longest known n-gram scores, down to single characters. The prediction is the language with the
highest sum; its score is the posterior of the mean score per word, with an even prior.

A null text, or one without a letter, is `und` with score 0; so is every text when there is nothing to learn from. Rows
of null lang or doc_id are not learnt from. Copies, ties and extra columns change nothing; equal sums go to the lang
that sorts first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.op4_quality import fold
from foliospark.llm.shared import Scratch, documents, mixed, pieces, spans

SAMPLE = 1_000
UNITS = 60_000
LONGEST = 5
WORD = re.compile(r"[^\W\d_]+")
STEP = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def counted_words(learn: DataFrame, sample: int) -> DataFrame | None:
    """(lang, word, times) of about ``sample`` texts of each language; None without a language."""
    share = {r["lang"]: min(1.0, sample / r["count"]) for r in learn.groupBy("lang").count().collect()}  # one row per language
    if not share:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    limit = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found: Counter = Counter()
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
                found.update((lang, word) for word in WORD.findall(text.lower()))
            langs, units = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(units, pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "times"])

    rows = learn.filter(place < limit).select("lang", "text").mapInArrow(run, "lang string, word string, times long")
    return rows.groupBy("word", "lang").agg(F.sum("times").alias("times"))


def counted_units(words: DataFrame) -> DataFrame:
    """(size, unit, lang, times): hashes of the words (size 0) and of their n-grams, counted as often as the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        for piece in pieces(batches, "word"):
            codes, starts, ends, first = coded(piece.column("word").to_pylist(), letter)
            row = np.repeat(np.arange(piece.num_rows), np.diff(first))
            langs = piece.column("lang").dictionary_encode()
            code, times = langs.indices.to_numpy(), piece.column("times").to_numpy()
            for size in range(LONGEST + 1):
                unit, word = units_of(codes, starts, ends, size)
                key = np.rec.fromarrays([unit, code[row[word]]], names="unit,lang")
                one, group = np.unique(key, return_inverse=True)
                sums = np.bincount(group, times[row[word]], len(one)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), size, np.int32)), pa.array(one.unit.view(np.int64)), langs.dictionary.take(pa.array(one.lang)), pa.array(sums)], ["size", "unit", "lang", "times"])

    rows = words.mapInArrow(run, "size int, unit long, lang string, times long")
    return rows.groupBy("size", "unit", "lang").agg(F.sum("times").alias("times"))


def learnt(learn: DataFrame, sample: int = SAMPLE, most: int = UNITS) -> Model:
    """The model of the units that each language knows: its most frequent ones, ``most`` of each size over all languages
    (and one of each language at least), with what every language has of them."""
    words = counted_words(learn, sample)
    if words is None:
        return Model([])
    scratch = Scratch(learn.sparkSession, "op5")
    units = scratch.store(counted_units(words))
    langs = sorted(r[0] for r in learn.select("lang").distinct().collect())  # one row per language
    first = Window.partitionBy("size", "lang").orderBy(F.desc("times"), "unit")
    known = units.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= max(1, most // len(langs))).select("size", "unit").distinct()
    rows = units.join(known, ["size", "unit"]).toArrow()  # units times languages at most
    scratch.drop(units)
    place = pa.compute.index_in(rows.column("lang").combine_chunks(), pa.array(langs)).to_numpy()
    size, unit, times = (rows.column(c).to_numpy() for c in ("size", "unit", "times"))
    tables = []
    for k in range(LONGEST + 1):
        own = size == k
        keys, at = np.unique(unit[own].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        np.add.at(counts, (at, place[own]), times[own])
        tables.append((keys, counts))
    return Model.of(langs, tables)


def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def coded(texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed characters of the texts, 0 where there is no letter; starts and ends of words, and where each text's begin."""
    lowered = [x.lower() for x in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n" * (LONGEST + 1)).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, (1 << 16) - 1)
    inside = letter[low]
    for k in np.flatnonzero(points >= 1 << 16):
        inside[k] = chr(points[k]).isalpha()
    bounds = 1 + np.concatenate(([0], np.cumsum([len(x) + 1 for x in lowered]))).astype(np.int64)
    starts, ends, first = spans(inside, bounds)
    return np.where(inside, mixed(points.astype(np.uint64) + np.uint64(7)), np.uint64(0)), starts, ends, first


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers = np.full(len(codes) + 1, STEP, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    inverse = np.full(len(codes) + 1, pow(int(STEP), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1])))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def gram_hashes(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    total = np.full(len(at), np.uint64(size))
    for k in range(size):
        total = total * STEP + codes[at + k]
    return mixed(total)


def units_of(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (size 0) or of their n-grams, marks for both word ends included, and the word of each."""
    if not size:
        return word_hashes(codes, starts, ends), np.arange(len(starts))
    lengths = np.maximum(ends - starts + 2 - size + 1, 0)
    word = np.repeat(np.arange(len(starts)), lengths)
    at = np.repeat(starts - 1 - np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64), lengths) + np.arange(lengths.sum())
    return gram_hashes(codes, at, size), word


class Model:
    """Hashes and log frequencies per language of known words (table 0) and of n-grams (table n)."""

    def __init__(self, rows: list):
        """From words with their counts, whose n-grams are all known."""
        langs = sorted({x["lang"] for r in rows for x in r["each"]})
        place = {x: k for k, x in enumerate(langs)}
        counts = np.zeros((len(rows), len(langs)))
        for k, r in enumerate(rows):
            for x in r["each"]:
                counts[k, place[x["lang"]]] += x["times"]
        codes, starts, ends, _ = coded([r["word"] for r in rows], letters())
        tables = []
        for size in range(LONGEST + 1):
            unit, word = units_of(codes, starts, ends, size)
            keys, group = np.unique(unit, return_inverse=True)
            tables.append((keys, np.column_stack([np.bincount(group, counts[word, k], len(keys)) for k in range(len(langs))]) if langs else np.zeros((0, 0))))
        self.take(langs, tables)

    @classmethod
    def of(cls, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """From sorted unit hashes and their counts by language, for words and each length of n-grams."""
        out = cls.__new__(cls)
        out.take(langs, tables)
        return out

    def take(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.letter, self.langs = letters(), langs
        self.tables = [(keys, np.log((sums + 0.5) / (sums.sum(0) + 0.5 * (len(keys) + 1)))) for keys, sums in tables]

    def grams(self, codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        return gram_hashes(codes, at, size)

    def scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log scores of each word in each language."""
        keys, values = self.tables[0]
        at = find(keys, word_hashes(codes, starts, ends))
        out = np.zeros((len(starts), len(self.langs)))
        out[at >= 0] = values[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        lengths = ends[new] - starts[new] + 2
        word = np.repeat(np.arange(len(new)), lengths)
        at = np.repeat(starts[new] - 1 - np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64), lengths) + np.arange(lengths.sum())
        last = np.repeat(ends[new] + 1, lengths)
        sums = np.zeros((len(new), len(self.langs)))
        for size in range(LONGEST, 0, -1):
            keys, values = self.tables[size]
            fits = np.flatnonzero(at + size <= last)
            hit = find(keys, self.grams(codes, at[fits], size))
            good = hit >= 0
            for k in range(len(self.langs)):
                sums[:, k] += np.bincount(word[fits[good]], values[hit[good], k], len(new))
            left = np.ones(len(at), bool)
            left[fits[good]] = False
            at, word, last = at[left], word[left], last[left]
        out[new] = sums * (3 / np.maximum(lengths, 1))[:, None]  # a word's n-grams overlap: together they weigh as three
        return out


def language(docs: DataFrame, sample: int = SAMPLE, most: int = UNITS) -> DataFrame:
    """One row per document: whether it was held out, the predicted language, and its posterior."""
    learn = docs.filter("lang is not null and doc_id is not null and text is not null").filter(fold("doc_id", 4) != 2)
    model = learnt(learn.select("lang", "doc_id", "text"), sample, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, size=500_000):
            codes, starts, ends, first = coded([x or "" for x in piece.column("text").to_pylist()], model.letter)
            counts = np.diff(first)
            preds, best = ["und"] * len(counts), np.zeros(len(counts))
            if model.langs and len(starts):
                sums = np.concatenate((np.zeros((1, len(model.langs))), np.cumsum(model.scores(codes, starts, ends), axis=0)))
                mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(counts, 1)[:, None]
                weight = np.exp(mean - mean.max(1, keepdims=True))
                top = np.round(mean, 9).argmax(1)
                best = np.where(counts > 0, (weight / weight.sum(1, keepdims=True))[np.arange(len(counts)), top], 0.0)
                preds = [model.langs[k] if c else "und" for k, c in zip(top, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), piece.column("held_out"), pa.array(preds, pa.string()), pa.array(best)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, SCHEMA)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(documents(spark, sf_dir))
