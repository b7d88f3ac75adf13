"""Removal of repeated byte strings: minimiser seeds and one sort of string hashes, in place of prefix doubling by rounds.

Every string of ``LENGTH`` bytes is to be found that also starts earlier. Plain prefix doubling would sort one
(rank, rank) pair for each byte of the corpus in each round. Here Spark sorts twice, and only positions that may still repeat:

1. Each string is represented by its seed, the ``SEED`` bytes in it whose hash is smallest (the leftmost of equals).
   Equal strings have equal seeds at equal offsets. Neighbouring strings with one seed make a run, and only the run's position is
   sorted, by the pair of the seed's rank and the rank of all bytes that the run spans. A position whose seed is unique
   leaves. Among equal pairs all positions but the first are done: the whole run repeats.
2. The first positions of a seed that has several different runs are spread out into their single strings. Their names are
   put together from those of ``LENGTH / 4`` bytes beside the text, with no sort in between. Spark sorts them once more; all but
   the first of equal names repeat.

A rank is a 64-bit hash of the bytes that it stands for, so that the pair at an offset is found beside the text and not
by a join. Equal pairs of one piece of rows meet before the sort and only their first is sent, and of a seed with very many
runs in a piece two are sorted and the others go to step 2 at once; so no sort key gathers more than a few rows from
each piece. Sorted rows are read as a stream, with the state of one position.

Strings never cross documents and are judged on the input. Order is doc_id (null first), then place. Rows that share a
doc_id, or have none, are told apart and ordered by a 64-bit hash of the text (``tie``, 0 for all where every doc_id stands once); exact
repeats of a row are one document and get the same result. Null and
empty texts, and those under ``LENGTH`` bytes, lose nothing. Extra columns change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import Scratch, documents, mixed, pieces, text_bytes

LENGTH = 100
SEED = 32
CROWD = 8
STEP = 0x9E3779B97F4A7C15
ROWS = "name long, pair long, doc long, tie long, place long, fine boolean"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


class Names:
    """Names (hashes) of all substrings of a stretch of bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        powers = np.full(len(data) + 1, STEP, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.inverse = np.full(len(data) + 1, pow(STEP, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, length: int) -> np.ndarray:
        return mixed((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(STEP) + second)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[: len(values) - span], values[span:]), span * 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def seed_runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of each run: its text, first string, number of strings, the seed's offset in the first one, seed name, pair."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    names = Names(data)
    seeds = names.all(seed)
    packed = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
    least = sliding_least(packed, length - seed + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= bounds[1:][text])
    if not len(start):
        return (none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, last = start[begin], start[np.append(begin[1:], len(start)) - 1]
    anchor = anchor[begin]
    count, offset = last - first + 1, anchor - first
    pair = paired(paired(seeds[anchor], names.of(first, last + length)), (offset * 128 + count).astype(np.uint64))
    return text[first], first, count, offset, seeds[anchor], pair


def place_of(start: np.ndarray, offset: np.ndarray | int, count: np.ndarray | int) -> np.ndarray:
    """One number per position: start in the text, and what the position stands for; sorts by start."""
    return (start.astype(np.int64) << 14) + (np.asarray(offset, np.int64) << 7) + count


def first_of(name: np.ndarray, doc: np.ndarray, tie: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows are the first, by doc, tie and place, of their name. Equal rows are all first."""
    order = np.lexsort((place, tie, doc, name))
    head = np.ones(len(name), bool)
    head[1:] = name[order][1:] != name[order][:-1]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(name)), 0))]
    out = np.zeros(len(name), bool)
    out[order] = (doc[order] == doc[lead]) & (tie[order] == tie[lead]) & (place[order] == place[lead])
    return out


def run_positions(docs: DataFrame) -> DataFrame:
    """Positions of runs to be sorted; also, with a null `fine`, positions already known to repeat, and, with `fine`
    true, those to be spread out. The latter two have a name of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            docs_, ties = piece.column("doc").to_numpy(), piece.column("tie").to_numpy()
            data, bounds = text_bytes(piece.column("text"))
            text, first, count, offset, seed, pair = seed_runs(data, bounds)
            if not len(text):
                continue
            doc, tie, place = docs_[text], ties[text], place_of(first - bounds[text], offset, count)
            ahead = first_of(pair, doc, tie, place)
            order = np.lexsort((pair, seed))
            order = order[ahead[order]]
            head = np.concatenate(([True], seed[order][1:] != seed[order][:-1]))
            change = head.copy()
            change[1:] |= pair[order][1:] != pair[order][:-1]
            rank = np.cumsum(change) - np.cumsum(change)[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            crowded = np.zeros(len(text), bool)
            crowded[order] = rank >= CROWD
            alone = ~ahead | crowded
            name = np.where(alone, mixed(place.view(np.uint64) ^ mixed(tie.view(np.uint64)) ^ pair), seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(pair.view(np.int64)), pa.array(doc), pa.array(tie), pa.array(place), pa.array(crowded & ahead, mask=~ahead)], NAMES
            )

    return docs.mapInArrow(run, ROWS)


def string_positions(docs: DataFrame) -> DataFrame:
    """The single strings of the listed runs (column places), named by doubling; repeats within a piece have a null `fine`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, size=1_000_000):
            docs_, ties = piece.column("doc").to_numpy(), piece.column("tie").to_numpy()
            data, bounds = text_bytes(piece.column("text"))
            lists = piece.column("places")
            places = lists.flatten().to_numpy()
            text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            count, begin = places & 127, (places >> 14) + bounds[text]
            start = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            if not len(start):
                continue
            text = np.repeat(text, count)
            quarter = LENGTH // 4
            names = Names(data).all(quarter)
            names = paired(names[: len(names) - quarter], names[quarter:])
            names = paired(names[start], names[start + 2 * quarter])
            doc, tie, place = docs_[text], ties[text], place_of(start - bounds[text], 0, 1)
            ahead = first_of(names, doc, tie, place)
            name = np.where(ahead, names, mixed(place.view(np.uint64) ^ mixed(tie.view(np.uint64)) ^ names))
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(names.view(np.int64)), pa.array(doc), pa.array(tie), pa.array(place), pa.array(np.zeros(len(doc), bool), mask=~ahead)], NAMES)

    return docs.mapInArrow(run, ROWS)


def sorted_repeats(rows: DataFrame) -> DataFrame:
    """(doc, tie, place, fine): positions that repeat an earlier equal pair, and (fine) first positions of names with several pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_name = last_pair = last_doc = last_tie = last_place = None  # of the row before
        seen, held = 0, None  # pairs so far of its name, and the first position while it is the only one
        for batch in batches:
            if not batch.num_rows:
                continue
            name, pair, doc, tie, place = (batch.column(c).to_numpy() for c in NAMES[:5])
            known = batch.column("fine").is_null().to_numpy(zero_copy_only=False)
            spread = batch.column("fine").fill_null(False).to_numpy(zero_copy_only=False)
            same_name = np.concatenate(([name[0] == last_name], name[1:] == name[:-1]))
            same_pair = same_name & np.concatenate(([pair[0] == last_pair], pair[1:] == pair[:-1]))
            lead = np.maximum.accumulate(np.where(same_pair, -1, np.arange(len(name))))
            lead_doc = np.where(lead < 0, 0 if last_doc is None else last_doc, doc[lead])
            lead_tie = np.where(lead < 0, 0 if last_tie is None else last_tie, tie[lead])
            lead_place = np.where(lead < 0, 0 if last_place is None else last_place, place[lead])
            copy = same_pair & (doc == lead_doc) & (tie == lead_tie) & (place == lead_place)  # a repeated row
            repeats = known | (same_pair & ~copy)
            group = np.cumsum(~same_name)  # 0: the name of the batch before
            pairs = np.bincount(group, ~same_pair, group[-1] + 1).astype(np.int64)
            pairs[0] += seen
            wanted = ~same_pair & ~known & ((pairs[group] > 1) | spread)
            docs_, ties, places, fine = [doc[repeats], doc[wanted]], [tie[repeats], tie[wanted]], [place[repeats], place[wanted]], [np.zeros(repeats.sum(), bool), np.ones(wanted.sum(), bool)]
            if held is not None and group[0] == 0 and pairs[0] > 1:
                docs_.append(np.array([held[0]]))
                ties.append(np.array([held[1]]))
                places.append(np.array([held[2]]))
                fine.append(np.ones(1, bool))
            if group[-1] or pairs[0] > 1:
                held = None
            seen = int(pairs[-1])
            if seen == 1 and group[-1] and not known[-1] and not spread[-1]:
                at = int(np.flatnonzero(group == group[-1])[0])
                held = (doc[at], tie[at], place[at])
            last = int(lead[-1])
            last_name, last_pair = name[-1], pair[-1]
            if last >= 0:
                last_doc, last_tie, last_place = doc[last], tie[last], place[last]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs_, ties, places, fine)], ["doc", "tie", "place", "fine"])

    ordered = rows.repartition("name").sortWithinPartitions("name", "pair", "doc", "tie", "place")
    return ordered.mapInArrow(run, "doc long, tie long, place long, fine boolean")


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes), from the places to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, bounds = text_bytes(piece.column("text"))
            lists = piece.column("places")
            offsets, places = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            offsets = offsets - offsets[0]
            rows = []
            for k in range(piece.num_rows):
                own = data[bounds[k] : bounds[k + 1]]
                spot = places[offsets[k] : offsets[k + 1]]
                if len(spot):
                    start = spot >> 14
                    change = np.zeros(len(own) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + (spot & 127) - 1 + LENGTH, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = own[~gone].tobytes()
                    rows.append((len(own), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest(), kept))
                else:
                    kept = own.tobytes()
                    rows.append((len(own), 0, 0, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept."""
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.coalesce("text", F.lit(""))
    shared = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long")).count().filter("count > 1").limit(1).count() > 0
    tie = F.when(F.col("doc_id").cast("long").isNull() | F.lit(shared), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), tie.alias("tie"), text.alias("text"))
    by_text = lambda rows: rows.groupBy("doc", "tie").agg(F.collect_list("place").alias("places"))
    runs = scratch.store(sorted_repeats(run_positions(keyed.select("doc", "tie", "text"))))
    several = by_text(runs.filter("fine"))
    spread = keyed.select("doc", "tie", "text").join(several, ["doc", "tie"]).select("doc", "tie", "text", "places")
    strings = scratch.store(sorted_repeats(string_positions(spread)))
    gone = by_text(runs.filter("not fine").unionByName(strings.filter("not fine")))
    none = F.array().cast("array<bigint>")
    return cut(keyed.join(gone, ["doc", "tie"], "left").select("doc_id", "text", F.coalesce("places", none).alias("places")))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


SQL = """
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM hexed),
strings AS (SELECT doc_id, i, CASE WHEN i + 100 <= len(h) // 2 THEN md5(substr(h, 2 * i + 1, 200)) END AS g, substr(h, 2 * i + 1, 2) AS byte FROM bytes),
again AS (SELECT *, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS repeats FROM strings),
marked AS (
  SELECT *, coalesce(max(CASE WHEN repeats THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone FROM again
),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
cut AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM runs GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM hexed LEFT JOIN cut USING (doc_id)
"""
