"""Runs of repeated words in each text, by longest common extensions on a difference cover.

A text is its words. A run is a stretch with smallest period q of at least ``max(LEAST, TIMES * q)`` words that cannot
be made longer. For each q, the words at multiples of q form a grid; the first grid word inside a run, at i, has words
i and i + q alike and goes on so for more than 2q words. So all runs come from pairs of neighbouring grid words
(n / 1 + n / 2 + ... of them), each with one extension to the right and, if that is long enough, one to the left.

Extensions are answered from suffixes that begin at sampled words only: those whose number modulo ``MODULUS`` is in a
difference cover. For any two words some shift below the modulus brings both to sampled ones; the words up to there are
compared directly, and from there a range minimum over the common prefixes of sorted sampled suffixes (a sparse table)
gives the rest. The samples are sorted by their first ``MODULUS`` words and then by doubling; texts end in words of
their own, so nothing is common across texts. Only texts with a pair of grid words that go on alike get an index.

Null and empty texts have no words, so no runs. A null doc_id has no checksum, so such a text is taken as it is. Rows
are independent: ties, copies and extra columns change nothing. Words are equal if their 64-bit hashes are. Texts are
worked on in batches of about a megabyte, or one text if that is longer; memory grows with the longest text only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.shared import WHITE, byte_table, documents, owner, per_text, pieces, span_hashes, spans, text_bytes

LEAST, TIMES = 6, 4
#: Every difference modulo 31 is one of two of these.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
PAIRS = 2_000_000
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def shifts() -> np.ndarray:
    """For residues of two words, the least shift that brings both into the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    out = np.empty((MODULUS, MODULUS), np.int64)
    for i in range(MODULUS):
        for j in range(MODULUS):
            out[i, j] = np.flatnonzero(inside[i : i + MODULUS] & inside[j : j + MODULUS])[0]
    return out


SHIFTS = shifts()
SLOT = np.full(MODULUS, -1)
SLOT[list(COVER)] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions to the right in a sequence of small positive numbers, whose last one stands once."""

    def __init__(self, words: np.ndarray):
        self.words = words
        blocks = -(-len(words) // MODULUS)
        place = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).ravel()
        place = place[place < len(words)]
        self.levels = [self._first_rank(place)]
        step = len(COVER)
        while step < len(place) and self.levels[-1].max() + 1 < len(place):
            last = self.levels[-1].astype(np.int64)
            after = np.zeros(len(last), np.int64)
            after[:-step] = last[step:] + 1
            self.levels.append(np.unique(last * (len(last) + 1) + after, return_inverse=True)[1].astype(np.int32))
            step *= 2
        self.rank = np.empty(len(place), np.int64)
        order = np.argsort(self.levels[-1], kind="stable")
        self.rank[order] = np.arange(len(place))
        self.table = [self._neighbours(place, order)]
        self.levels = []
        width = 1
        while 2 * width <= len(self.table[0]):
            low = self.table[-1]
            self.table.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def _first_rank(self, place: np.ndarray) -> np.ndarray:
        """Ranks of the sampled suffixes by their first words; several words share one sort key."""
        bits = max(1, int(self.words.max(initial=0)).bit_length())
        many = max(1, 63 // bits)
        padded = np.concatenate((self.words, np.zeros(MODULUS + many, np.int64)))
        keys = []
        for first in range(0, MODULUS, many):
            key = np.zeros(len(place), np.int64)
            for k in range(first, min(first + many, MODULUS)):
                key = (key << bits) | padded[place + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(place), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(place), np.int32)
        rank[order] = np.cumsum(new)
        return rank

    def _neighbours(self, place: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Common words of each sorted sampled suffix and the next, from the ranks of all levels."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], len(COVER) << k
            there = np.flatnonzero((a < len(level)) & (b < len(level)))
            there = there[level[a[there]] == level[b[there]]]
            common[there] += MODULUS << k
            a[there] += step
            b[there] += step
        return common + self._direct(place[order[:-1]] + common, place[order[1:]] + common, np.full(len(a), MODULUS))

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common words from i and j on, ``most`` at most, one by one."""
        common = np.zeros(len(i), np.int64)
        alive = np.arange(len(i))
        for k in range(MODULUS):
            alive = alive[(most[alive] > k) & (np.maximum(i[alive], j[alive]) + k < len(self.words))]
            alive = alive[self.words[i[alive] + k] == self.words[j[alive] + k]]
            if not len(alive):
                break
            common[alive] = k + 1
        return common

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = SHIFTS[i % MODULUS, j % MODULUS]
        common = self._direct(i, j, shift)
        far = np.flatnonzero(common == shift)
        a, b = (x[far] + shift[far] for x in (i, j))
        a, b = (self.rank[x // MODULUS * len(COVER) + SLOT[x % MODULUS]] for x in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            at, row = np.flatnonzero(level == k), self.table[k]
            common[far[at]] += np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return common


def ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def gathered(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... for each stretch k."""
    return np.repeat(first, counts) + ranges(counts)


def grid_pairs(words: np.ndarray, base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and period of neighbouring grid words that go on alike for a few words, in texts of n words at base."""
    periods = n // TIMES
    text = np.repeat(np.arange(len(n)), periods)
    q = ranges(periods) + 1
    counts = (n[text] - 1) // q - (TIMES - 2)
    ends = np.cumsum(counts)
    found, k = [], 0
    while k < len(q):
        last = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        some = np.repeat(np.arange(k, last), counts[k:last])
        step = q[some]
        place = base[text[some]] + ranges(counts[k:last]) * step
        here = words[place]
        alike = np.flatnonzero(here == words[place + step])
        place, step, some = place[alike], step[alike], some[alike]
        alike = (words[place + 1] == words[place + step + 1]) & (words[place + 2] == words[place + step + 2])
        alike &= (words[place + step] == words[place + 2 * step]) & (words[place + step] == words[place + 3 * step])
        found.append((text[some[alike]], place[alike], step[alike]))
        k = last
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def all_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs of all texts as rows (text, start, length, period), sorted; text k has the numbers words[first[k]:first[k + 1]]."""
    n = np.diff(first)
    text, place, q = grid_pairs(words, first[:-1], n)
    if not len(text):
        return np.zeros((0, 4), np.int64)
    some, text = np.unique(text, return_inverse=True)
    # the texts with pairs, each between two numbers that stand nowhere else
    numbers = np.unique(words[gathered(first[some], n[some])], return_inverse=True)[1] + 1
    base = np.cumsum(n[some] + 1) - n[some]
    joined = np.empty(int(n[some].sum()) + len(some) + 1, np.int64)
    joined[np.concatenate(([0], base + n[some]))] = numbers.max() + 1 + np.arange(len(some) + 1)
    joined[gathered(base, n[some])] = numbers
    place = place - first[some][text] + base[text]
    right = Extensions(joined)(place, place + q)
    long = right > (TIMES - 2) * q
    text, place, q, right = text[long], place[long], q[long], right[long]
    if not len(text):
        return np.zeros((0, 4), np.int64)
    end = len(joined) - 1
    left = Extensions(joined[::-1].copy())(end - (place + q - 1), end - (place - 1))
    length = left + q + right
    whole = (left < q) & (length >= np.maximum(LEAST, TIMES * q))
    rows = np.stack((some[text], place - left - base[text], length, q), 1)[whole]
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)  # a stretch of a smaller period comes again with its multiples
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def planted(ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """For each word the number of the word that stands in its place: every tenth text by checksum ends periodically."""
    out = np.arange(first[-1])
    for k, doc_id in enumerate(ids):
        n = int(first[k + 1] - first[k])
        checksum = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if n and checksum is not None and checksum % 10 == 0:
            seed = checksum // 10
            begin = seed % n
            period = 1 + (n - begin) // (3 + seed % 8)
            out[first[k] + begin : first[k + 1]] = first[k] + begin + np.arange(n - begin) % period
    return out


def joined_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The words of each text with one space between them."""
    sizes = ends - starts
    place = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    out[gathered(place, sizes)] = data[gathered(starts, sizes)]
    bound = np.append(place, len(out))[first]
    whole = out.tobytes()
    return [whole[a : max(a, b - 1)] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def run_rows(piece: pa.RecordBatch, plant: bool) -> pa.RecordBatch:
    data, bounds = text_bytes(piece.column("text"))
    starts, ends, first = spans(~byte_table(WHITE)[data], bounds)
    words = np.unique(span_hashes(data, starts, ends), return_inverse=True)[1].astype(np.int64)
    doc_id = piece.column("doc_id").cast(pa.int64())
    if plant:
        source = planted(doc_id.to_pylist(), first)
        words, starts, ends = words[source], starts[source], ends[source]
    runs = all_runs(words, first)
    count = np.bincount(runs[:, 0], minlength=len(first) - 1).astype(np.int64)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(cover, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    kept = np.cumsum(cover)[:-1] == 0
    bound = np.concatenate(([0], np.cumsum(per_text(kept, first))))
    collapsed = [hashlib.sha256(x).hexdigest() for x in joined_texts(data, starts[kept], ends[kept], bound)]
    place = np.concatenate(([0], np.cumsum(count)))
    best = runs[np.lexsort((runs[:, 3], runs[:, 1], -runs[:, 2], runs[:, 0]))]
    top = np.zeros((len(count), 4), np.int64)
    top[count > 0] = best[place[:-1][count > 0]]
    none = pa.array(count == 0)
    lines = [f"{s},{n},{q}\n" for _, s, n, q in runs.tolist()]
    told = [hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
    column = lambda x: pa.array(x, mask=none.to_numpy(zero_copy_only=False))
    exponent = 1000 * top[:, 2] // np.maximum(top[:, 3], 1)
    arrays = [doc_id, pa.array(count), column(top[:, 1]), column(top[:, 2]), column(top[:, 3]), column(exponent), pa.array(told, pa.string()), pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])


def word_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per document: its number of runs, its longest run, and digests of all runs and of the text in which
    each run stands with its first period only. ``plant`` first makes every tenth text end periodically."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield run_rows(piece, plant)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def run_list(docs: DataFrame) -> DataFrame:
    """One row per run: doc_id, start, length, period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, bounds = text_bytes(piece.column("text"))
            starts, ends, first = spans(~byte_table(WHITE)[data], bounds)
            runs = all_runs(np.unique(span_hashes(data, starts, ends), return_inverse=True)[1].astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()).take(pa.array(runs[:, 0])), *(pa.array(runs[:, k]) for k in (1, 2, 3))], ["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs(documents(spark, sf_dir), plant=True)
