"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments, each over a run of whole documents and written to the shared folder: for each term
(a word's 64-bit hash) the places where it stands, counted over the segment with a gap after each document, so that no
match crosses documents. Terms that no test item has are left out as long as the items' vocabulary is small; else the
index holds all terms. A test item is cut into windows of ``WIDTH`` words (a shorter item is one window). For each
window the list of its rarest term, by counts over the whole corpus, gives candidate places; they must lie in the
lists of the next rarest terms too, moved by the difference of their offsets; what is left is followed word by word
through the lists, to both sides of the rarest. With ``slop`` above 0, up to that many other words may stand between
the window's words; a match without any is exact. Test items are searched in blocks of a bounded number of words, so
there may be any number of them; segments never meet, so there is no shuffle unless there are several blocks.

Null and empty texts have no words and are never hit; items without words have no windows. Items of one item_id count
as one item, those of null item_id as one whose name is empty. Repeated rows are judged one by one; extra columns
change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import Scratch, byte_table, documents, lower_table, owner, pieces, span_hashes, spans, text_bytes

WIDTH = 10
BLOCK_WORDS = 1_000_000
SEGMENT = 2_000_000
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
SEGMENTS = "segment long, doc_ids binary, known binary, begins binary, terms binary, counts binary, places binary"


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin."""
    data, bounds = text_bytes(column)
    data = lower_table()[data]
    starts, ends, first = spans(byte_table(WORD_BYTES)[data], bounds)
    return span_hashes(data, starts, ends), first


def item_words(items: DataFrame) -> DataFrame:
    """item_id as text, number of words, and the words' hashes, one row per item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hashes, first = hashed_words(piece.column("text"))
            words = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("item_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(words, pa.binary())], ["item_id", "n", "words"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return named.mapInArrow(run, "item_id string, n long, words binary").filter("n > 0")


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """Segments of the positional index; only terms of the sorted ``vocabulary`` where one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, piece in enumerate(pieces(batches, size=SEGMENT)):
            hashes, first = hashed_words(piece.column("text"))
            places = (np.arange(len(hashes)) + owner(first)).astype(np.int64)  # one place stays free after each document
            begins = (first + np.arange(len(first))).astype(np.int64)
            if vocabulary is not None:
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                listed = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                hashes, places = hashes[listed], places[listed]
            order = np.argsort(hashes, kind="stable")
            terms, counts = np.unique(hashes, return_counts=True)
            gaps = np.diff(places[order], prepend=0).astype(np.int32)
            ids = piece.column("doc_id").cast(pa.int64())
            columns = [ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), begins, terms, counts.astype(np.int64), gaps]
            segment = (TaskContext.get().partitionId() << 32) + k
            yield pa.RecordBatch.from_arrays([pa.array([segment]), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns)], [x.split()[0] for x in SEGMENTS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SEGMENTS)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted ``terms`` stands in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own, counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int64)
                at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
                hit = terms[at] == own
                total[at[hit]] += counts[hit]
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["term", "times"])

    out = np.zeros(len(terms), np.int64)
    if len(terms):
        for term, times in index.select("terms", "counts").mapInArrow(run, "term long, times long").groupBy("term").agg(F.sum("times")).collect():  # one row per term of the block
            out[term] = times
    return out


def cut_windows(items: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first word (over all items in a row) and length of each window."""
    lengths = np.array([len(x) for x in items], np.int64)
    counts = np.maximum(lengths - width + 1, 1)
    begins = np.cumsum(lengths) - lengths
    if not items:
        return lengths, lengths, lengths
    item = np.repeat(np.arange(len(items)), counts)
    start = np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return item, start, np.minimum(lengths, width)[item]


class Search:
    """The windows of one block of items, with each window's offsets from its rarest term on."""

    def __init__(self, names: list[str], items: list[np.ndarray], terms: np.ndarray, counts: np.ndarray, width: int, slop: int):
        self.names, self.slop, self.width = names, slop, width
        self.words = np.concatenate([*items, np.zeros(1, np.uint64)])  # one more, so that there is a last word
        self.item, self.start, self.length = cut_windows(items, width)
        rare = np.append(counts[np.searchsorted(terms, self.words[:-1])], 0)
        offsets = np.arange(width)
        inside = offsets < self.length[:, None]
        times = np.where(inside, rare[np.minimum(self.start[:, None] + offsets, len(self.words) - 1)], np.iinfo(np.int64).max)
        possible = times.min(1) > 0
        self.item, self.start, self.length, times = (x[possible] for x in (self.item, self.start, self.length, times))
        self.order = np.argsort(times, axis=1, kind="stable")

    def matches(self, terms: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, first and last place of each match in a segment; keys are term << 32 | place, sorted."""
        none = np.zeros(0, np.int64)
        if not len(terms) or not len(self.start):
            return none, none, none
        at = np.minimum(np.searchsorted(terms, self.words), len(terms) - 1)
        ids = np.where(terms[at] == self.words, at, -1)
        missing = np.concatenate(([0], np.cumsum(ids < 0)))
        whole = np.flatnonzero(missing[self.start + self.length] == missing[self.start])
        anchor = self.order[whole, 0]
        term = ids[self.start[whole] + anchor]
        count, begin = sizes[term], (np.cumsum(sizes) - sizes)[term]
        window = np.repeat(whole, count)
        anchor = np.repeat(anchor, count)
        place = keys[np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] & 0xFFFFFFFF
        for k in range(1, min(4, self.width)):
            other = self.order[window, k]
            checked = other < self.length[window]
            shift = other - anchor
            low = place + shift - np.where(shift < 0, self.slop, 0)
            wanted = ids[np.where(checked, self.start[window] + other, 0)] << 32
            found = np.searchsorted(keys, wanted + np.maximum(low, 0))
            near = keys[np.minimum(found, len(keys) - 1)]
            good = ~checked | ((found < len(keys)) & (near >= wanted) & (near <= wanted + place + shift + np.where(shift > 0, self.slop, 0)))
            window, anchor, place = window[good], anchor[good], place[good]
        first, last = place.copy(), place.copy()
        for k in range(1, self.width):  # the words after the rarest, then those before it
            for to_right in (True, False):
                offset = anchor + k if to_right else anchor - k
                live = (offset < self.length[window]) if to_right else (offset >= 0)
                wanted = ids[np.where(live, self.start[window] + offset, 0)] << 32
                found = np.searchsorted(keys, wanted + last + 1) if to_right else np.searchsorted(keys, wanted + first) - 1
                near = keys[np.clip(found, 0, len(keys) - 1)]
                good = (found >= 0) & (found < len(keys)) & (near >> 32 == wanted >> 32)
                near = near & 0xFFFFFFFF
                if to_right:
                    last = np.where(live & good, near, last)
                else:
                    first = np.where(live & good, near, first)
                held = ~live | (good & (last - first <= np.minimum(offset if to_right else self.length[window], self.length[window] - 1) + self.slop))
                window, anchor, first, last = window[held], anchor[held], first[held], last[held]
        fits = last - first < self.length[window] + self.slop
        return window[fits], first[fits], last[fits]


def find_matches(index: DataFrame, search: Search) -> DataFrame:
    """One row per document: segment, ordinal, doc_id, n_words, hits (places of exact matches), items (exact), near (items with any match)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, known, begins = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["begins"], np.int64)
                terms, sizes = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int64)
                keys = (np.repeat(np.arange(len(terms)), sizes) << 32) + np.cumsum(np.frombuffer(row["places"], np.int32), dtype=np.int64)
                window, first, last = search.matches(terms, keys, sizes)
                doc = np.searchsorted(begins, first, "right") - 1
                inside = doc == np.searchsorted(begins, last, "right") - 1
                window, first, last, doc = window[inside], first[inside], last[inside], doc[inside]
                exact = last - first + 1 == search.length[window]
                cover = np.zeros(begins[-1] + 1, np.int64)
                np.add.at(cover, first[exact], 1)
                np.add.at(cover, last[exact] + 1, -1)
                hit = np.flatnonzero(np.cumsum(cover) > 0)
                hits = np.split(hit, np.searchsorted(hit, begins[1:-1])) if len(doc_ids) else []
                listed: list[set] = [set() for _ in doc_ids]
                near: list[set] = [set() for _ in doc_ids]
                for d, w, e in {*zip(doc.tolist(), search.item[window].tolist(), exact.tolist(), strict=True)}:
                    near[d].add(search.names[w])
                    if e:
                        listed[d].add(search.names[w])
                texts = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * len(doc_ids), pa.int64()), pa.array(np.arange(len(doc_ids))), pa.array(doc_ids, mask=~known), pa.array(np.diff(begins) - 1),
                     pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(x) for x in listed], texts), pa.array([sorted(x) for x in near], texts)],
                    ["segment", "ordinal", "doc_id", "n_words", "hits", "items", "near"],
                )

    return index.mapInArrow(run, "segment long, ordinal long, doc_id long, n_words long, hits array<long>, items array<string>, near array<string>")


def blocks(words: DataFrame, most: int) -> Iterator[list]:
    """The items in blocks of about ``most`` words."""
    block, held = [], 0
    for row in words.toLocalIterator():
        block.append(row)
        held += row["n"]
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def decontamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, and n_near (items with a match within ``slop``)."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    words = scratch.store(item_words(items))
    total = words.agg(F.sum("n")).first()[0] or 0
    one = total <= block_words
    vocabulary = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in words.select("words").collect()] or [np.zeros(0, np.uint64)])) if one else None
    index = scratch.store(build_index(docs, vocabulary))
    found = []
    for block in blocks(words, block_words):
        own = [np.frombuffer(r["words"], np.uint64) for r in block]
        terms = np.unique(np.concatenate(own))
        search = Search([r["item_id"] for r in block], own, terms, term_counts(index, terms), width, slop)
        found.append(find_matches(index, search))
    if not found:
        found.append(find_matches(index, Search([], [], np.zeros(0, np.uint64), np.zeros(0, np.int64), width, slop)))
    rows = found[0]
    if len(found) > 1:  # a document's rows are as many as there are blocks
        for other in found[1:]:
            rows = rows.unionByName(other)
        joined = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        rows = rows.groupBy("segment", "ordinal").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), joined("hits"), joined("items"), joined("near"))
    names = F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256)
    n_hit = F.size("hits").cast("long")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns, in one pass per block of items over an index of each run of rows.

    The segment of a run of rows is built and searched where the rows are, so texts are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "clean")
    words = scratch.store(item_words(items))
    out = docs
    for block in blocks(words, BLOCK_WORDS):
        own = [np.frombuffer(r["words"], np.uint64) for r in block]
        terms = np.unique(np.concatenate(own))
        counts = word_counts(docs, terms)
        out = out.mapInArrow(clean_rows(Search([r["item_id"] for r in block], own, terms, counts, WIDTH, 0), terms), docs.schema)
    return out


def word_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted ``terms`` stands in the texts, without an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for piece in pieces(batches):
            hashes, _ = hashed_words(piece.column("text"))
            at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
            total += np.bincount(at[terms[at] == hashes], minlength=len(terms))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["term", "times"])

    out = np.zeros(len(terms), np.int64)
    for term, times in docs.select("text").mapInArrow(run, "term long, times long").groupBy("term").agg(F.sum("times")).collect():  # one row per term of the block
        out[term] = times
    return out


def clean_rows(search: Search, vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, size=SEGMENT):
            hashes, first = hashed_words(piece.column("text"))
            places = np.arange(len(hashes)) + owner(first)
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            listed = vocabulary[at] == hashes
            keys = np.sort((at[listed].astype(np.int64) << 32) + places[listed])
            _, start, _ = search.matches(vocabulary, keys, np.bincount(at[listed], minlength=len(vocabulary)))
            hit = np.zeros(piece.num_rows, bool)
            hit[np.searchsorted(first + np.arange(len(first)), start, "right") - 1] = True
            yield piece.filter(pa.array(~hit))

    return run


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_near")


SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
),
items AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lowered, lengths WHERE len(w) >= k)
),
found AS (SELECT rid, item, k, i FROM grams JOIN windows USING (k, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid),
listed AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(listed.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
"""
