"""Jaccard self-join of word 5-gram sets by count vectors: all links of 0.8 and more between different sets, as components.

A document's shingles are hashed into groups; its group counts are a point. The overlap of two sets is at most the sum
of the coordinate minima of their points, and the same holds for a point and the upper corner of a tree node over many
points. Steps, each a Spark job over whole tables:

1. Every text becomes its set's size, fingerprint and point. Equal sets count as one from here on. Shingles are counted
   in ``GROUPS`` coarse groups, which orders the groups from rare to frequent.
2. Cells, the first level of the index: of sets that reach 0.8, each has one of its ``n - ceil(0.8 n) + 1`` rarest
   shingles in common with the other, so the sets that share such a shingle meet in its cell. Cells of the same
   sets are one.
3. The pairs of a small cell, and in a cell of over ``CROWD`` sets those of its two smallest ids, are candidates if the
   bound of their points reaches 0.8.
4. Candidate pairs are verified on their whole texts, and verified links become components.
5. Crowded cells that are still in several components are searched by R-trees. Their sets, each once however many cells
   it is in, are dealt into blocks of about ``BLOCK`` bytes by size and hash, and a block's points get a tree. A set that
   is outside of the largest component of a cell is sent to the blocks that hold sets of that cell, ``QUERIES`` to a task,
   and searches them. What it finds in its cells under other components is verified too, the likeliest pairs first and
   then ``MORE`` times as many a round, with components renewed in between, until none are left. So no link that could
   join components is left out, copies are not expanded into all pairs, and no task holds more than one block.

Null and empty texts, and texts without a word, have no shingle and no link; a text of fewer than five words is one
shingle. Documents of a null doc_id have a null component and link nothing; rows that share a doc_id are judged each by
its own text.
Repeated rows keep a row each; extra columns change nothing. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliospark.llm.components import components
from foliospark.llm.shared import WHITE, Bitmap, Scratch, bit_of, byte_table, documents, lower_table, mixed, pieces, span_hashes, spans, text_bytes, window_hashes

WIDTH = 5
GROUP_BITS = 18
CROWD = 6
LEAF = 16
SEEN = 200_000
BLOCK = 250_000
QUERIES = 500
MORE = 64


def document_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    data, bounds = text_bytes(column)
    data = lower_table()[data]
    starts, ends, first = spans(~byte_table(WHITE)[data], bounds)
    words = span_hashes(data, starts, ends)
    windows = window_hashes(words, WIDTH)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(windows[a : b - WIDTH + 1]))
        else:
            out.append(window_hashes(words[a:b] + np.uint64(b - a), b - a) if b > a else words[:0])
    return out


def group_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - GROUP_BITS)).astype(np.int64)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set."""
    sums = mixed(shingles).sum(dtype=np.uint64), mixed(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return tuple(int(mixed(np.array([x]))[0].view(np.int64)) for x in sums)


def point(shingles: np.ndarray) -> bytes:
    """Counts of the set in 16 to 65,536 groups, one to two groups a shingle; 255 stands for that many or more."""
    groups = 1 << int(np.clip(np.ceil(np.log2(max(len(shingles), 1))), 4, 16))
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def folded(points: list[np.ndarray], groups: int = 1 << 16) -> np.ndarray:
    """The points in the number of groups of the coarsest (or in ``groups``), one row each; a count of 255 or more is unbounded."""
    groups = min(groups, *(len(p) for p in points))
    rows = np.empty((len(points), groups), np.int16)
    for k, p in enumerate(points):
        sums = p.reshape(-1, groups).sum(0, dtype=np.int32)
        if p.max() == 255:
            sums[(p == 255).reshape(-1, groups).any(0)] = 1 << 14
        rows[k] = np.minimum(sums, 1 << 14)
    return rows


class Tree:
    """Packed R-tree over points, ordered by set size; a node has its points' upper corner and least size."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray, groups: int = 1 << 16):
        self.order = np.argsort(sizes, kind="stable")
        self.points, self.sizes = folded(points, groups)[self.order], sizes[self.order]
        self.levels = []
        corner, low, high = self.points, self.sizes, self.sizes
        while len(corner) > LEAF:
            cut = np.arange(0, len(corner), LEAF)
            corner, low, high = np.maximum.reduceat(corner, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((corner, low, high))

    def search(self, place: int) -> np.ndarray:
        """Places (in size order) of the other points whose bound with this one reaches 0.8, the highest bound first."""
        nodes = self.near(self.points[place], self.sizes[place])[0]
        return nodes[nodes != place]

    def near(self, query: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in size order) of the points whose bound with a set of this point and size reaches 0.8, and that bound's
        share of both sizes, the highest first."""

        def reach(corner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            fits = (5 * low <= (size * 25) // 4 + 5) & (5 * high >= 4 * size)
            bound = np.minimum(corner, query).sum(1, dtype=np.int64)
            return fits & (180 * bound >= 80 * (size + np.maximum(low, -(-4 * size // 5))))

        nodes = None
        for corner, low, high in reversed(self.levels):
            at = np.arange(len(corner)) if nodes is None else nodes[nodes < len(corner)]
            at = at[reach(corner[at], low[at], high[at])]
            nodes = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        nodes = np.arange(len(self.sizes)) if nodes is None else nodes[nodes < len(self.sizes)]
        nodes = nodes[reach(self.points[nodes], self.sizes[nodes], self.sizes[nodes])]
        bound = np.minimum(self.points[nodes], query).sum(1, dtype=np.int64) / (size + self.sizes[nodes])
        order = np.argsort(-bound, kind="stable")
        return nodes[order], bound[order]


def measured(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, hi, lo, point) and, for each task, of shingle groups (cell, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << GROUP_BITS, np.int64)
        names = ["doc_id", "n", "hi", "lo", "point", "cell", "times"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for piece in pieces(batches):
            sets = document_sets(piece.column("text"))
            if sets:
                total += np.bincount(group_of(np.concatenate(sets)), minlength=len(total))
            prints = [fingerprint(s) for s in sets]
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in prints], pa.int64()), pa.array([x for _, x in prints], pa.int64()),
                 pa.array([point(s) for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names,
            )
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(full), k) for k in kinds[:5]), pa.array(full, pa.int32()), pa.array(total[full])], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, hi long, lo long, point binary, cell int, times long")


def rarity(rows: DataFrame) -> np.ndarray:
    """Rank of each shingle group, the rarest first; one number per group, whatever the input."""
    times = np.zeros(1 << GROUP_BITS, np.int64)
    for cell, n in rows.filter("cell is not null").groupBy("cell").agg(F.sum("times")).collect():
        times[cell] = n
    rank = np.empty(len(times), np.uint64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times), dtype=np.uint64)
    return rank


def rare_shingles(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(token, sid) of the rarest shingles of each set; equal sets of one task are written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        low = np.uint64((1 << (64 - GROUP_BITS)) - 1)
        for piece in pieces(batches):
            tokens, owners = [], []
            for s in document_sets(piece.column("text")):
                if not len(s) or (sid := fingerprint(s)[0]) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sid)
                token = (rank[group_of(s)] << np.uint64(64 - GROUP_BITS)) | (s & low)
                take = len(s) - (4 * len(s) + 4) // 5 + 1
                token = np.partition(token, take - 1)[:take]
                tokens.append(token.view(np.int64))
                owners.append(np.full(take, sid))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners))], ["token", "sid"])

    return docs.filter("doc_id is not null").select("text").mapInArrow(run, "token long, sid long")


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def cells(tokens: DataFrame) -> DataFrame:
    """(cell, sid): the distinct groups of two or more sets that share a rare shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gathered(batches)
        if table is None:
            return
        token, sid = table.column("token").to_numpy(), table.column("sid").to_numpy()
        order = np.lexsort((sid, token))
        token, sid = token[order], sid[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
        token, sid = token[new], sid[new]
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(begin, len(token)))
        cell = np.add.reduceat(mixed(sid.view(np.uint64)), begin).view(np.int64) ^ size
        _, one_each = np.unique(cell, return_index=True)
        kept = np.zeros(len(begin), bool)
        kept[one_each] = True
        kept &= size > 1
        rows = np.repeat(kept, size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cell, size)[rows]), pa.array(sid[rows])], ["cell", "sid"])

    return tokens.repartition("token").mapInArrow(run, "cell long, sid long").distinct()


def first_pairs(members: DataFrame) -> DataFrame:
    """(a, b): all pairs of a small cell; in a crowded one those of the two smallest ids, so that cells choose alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gathered(batches)
        if table is None:
            return
        cell, sid = table.column("cell").to_numpy(), table.column("sid").to_numpy()
        order = np.lexsort((sid, cell))
        cell, sid = cell[order], sid[order]
        begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        size = np.diff(np.append(begin, len(cell)))
        rank = np.arange(len(cell)) - np.repeat(begin, size)
        wide = np.repeat(size, size)
        found = []
        for step in range(1, CROWD):  # every id with the one ``step`` places before it
            rows = np.flatnonzero((rank >= step) & (wide <= CROWD))
            found.append(np.column_stack((sid[rows - step], sid[rows])))
        for pivot in range(2):
            rows = np.flatnonzero((rank > pivot) & (wide > CROWD))
            found.append(np.column_stack((sid[rows - rank[rows] + pivot], sid[rows])))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    return members.repartition("cell").mapInArrow(run, "a long, b long").distinct()


def bounded_pairs(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose points allow 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist(), batch.column("a_point").to_pylist(), batch.column("b_point").to_pylist(), strict=True)
            kept = [len(Tree([np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)], np.array([m, n])).search(0)) > 0 for m, n, p, q in sides]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    side = lambda name: points.select(F.col("sid").alias(name), F.col("n").alias(f"{name}_n"), F.col("point").alias(f"{name}_point"))
    alike = (4 * F.col("a_n") <= 5 * F.col("b_n")) & (4 * F.col("b_n") <= 5 * F.col("a_n"))
    # most pairs share a passage only and differ in size: they go before points are shuffled with them. Sizes of all sets are
    # no table to broadcast
    sizes = points.select(F.col("sid").alias("b"), F.col("n").alias("b_n")).hint("merge")
    sized = pairs.join(sizes, "b").join(side("a"), "a").filter(alike)
    return sized.join(side("b").drop("b_n"), "b").mapInArrow(run, "a long, b long")


class Block:
    """The sets of one block, found by the cells that they are in and by trees over their points."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.sid, self.size, self.label = (table.column(c).to_numpy() for c in ("sid", "n", "label"))
        self.points = [np.frombuffer(p.as_py(), np.uint8) for p in table.column("point")]
        lists = table.column("cells").combine_chunks()
        cells, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(cells, kind="stable")
        self.cells, self.owner = cells[order], owner[order]
        self.trees: dict[int, Tree] = {}

    def near(self, point: np.ndarray, size: int, label: int, cells: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets of these cells under other labels that may reach 0.8, up to ``most`` + 1 of a label, and their bounds."""
        groups = min(len(point), min(len(p) for p in self.points))
        if groups not in self.trees:
            self.trees[groups] = Tree(self.points, self.size, groups)
        tree = self.trees[groups]
        at, bound = tree.near(folded([point], groups)[0], size)
        at = tree.order[at]
        fits = self.label[at] != label
        at, bound = at[fits], bound[fits]
        if len(at):
            mates = np.zeros(len(self.sid), bool)
            for low, high in zip(np.searchsorted(self.cells, cells, "left"), np.searchsorted(self.cells, cells, "right"), strict=True):
                mates[self.owner[low:high]] = True
            at, bound = at[mates[at]], bound[mates[at]]
        order = np.argsort(self.label[at], kind="stable")
        names = self.label[at][order]
        begin = np.flatnonzero(np.concatenate((np.ones(min(len(names), 1), bool), names[1:] != names[:-1])))
        rank = np.arange(len(names)) - np.repeat(begin, np.diff(np.append(begin, len(names))))
        kept = order[rank <= most]
        return at[kept], bound[kept]


def block_pairs(rows: DataFrame, most: int) -> DataFrame:
    """(q, x, label, bound) of rows (block, slice, asks, sid, n, label, point, cells): what each asking set finds in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            where, part, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "slice", "asks"))
            cut = np.flatnonzero((where[1:] != where[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if (where[low], part[low]) != key:
                    key, held, block = (where[low], part[low]), [], None
                stretch = batch.slice(low, high - low)
                if not asks[low]:
                    held.append(stretch)
                    continue
                block = block or Block(held)
                for k in range(stretch.num_rows):
                    sid, size, label = (stretch.column(c)[k].as_py() for c in ("sid", "n", "label"))
                    point = np.frombuffer(stretch.column("point")[k].as_py(), np.uint8)
                    at, bound = block.near(point, size, label, stretch.column("cells")[k].values.to_numpy(), most)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), sid)), pa.array(block.sid[at]), pa.array(block.label[at]), pa.array(bound)], ["q", "x", "label", "bound"])

    dealt = rows.repartition("block", "slice").sortWithinPartitions("block", "slice", "asks")
    return dealt.mapInArrow(run, "q long, x long, label long, bound double")


def dealt_sets(crowds: DataFrame) -> DataFrame:
    """The crowds with the band of size and the block that each set lies in.

    A set goes with the most crowded of its cells, so that sets that meet in many cells meet in one block, or in few. Of a cell
    whose sets, were they all of the band's size, weigh more than a block, the sets are spread by hash over as many blocks as
    they would fill; lighter ones share the band's blocks.
    """
    weight = lambda n: F.least(2 * n, F.lit(1 << 16))
    sets = crowds.groupBy("sid", "n").agg(F.count("*").alias("cells"))
    bands = sets.groupBy(band("n").alias("band")).agg(F.sum(weight(F.col("n")) + 8 * F.col("cells"))).collect()  # a few for each doubling of the size
    shared = F.create_map(*[F.lit(x).cast("long") for key, total in [*bands, (-1, 0)] for x in (key, total // BLOCK + 1)])[F.col("band")]
    home = F.max(F.struct("k", "cell")).over(Window.partitionBy("sid"))  # a set has fewer cells than shingles
    rows = crowds.withColumn("band", band("n")).withColumn("home", home)
    full = F.ceil(F.col("home.k") * weight(F.pow(F.lit(2.0), F.col("band") / 4)) / BLOCK)
    own = F.pmod(F.xxhash64("home.cell", F.pmod(F.xxhash64("sid"), full)), F.lit(1 << 39))
    place = F.when(full > 1, own).otherwise((1 << 39) + F.pmod(F.xxhash64("home.cell"), shared))
    return rows.withColumn("block", F.col("band") * (1 << 40) + place).drop("home")


def band(n: Column) -> Column:
    """A quarter of a doubling of a set's size."""
    return F.ceil(4 * F.log2(n)).cast("long")


def crowd_rows(crowds: DataFrame, points: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``block_pairs`` for crowds (cell, sid, n, label, main, k): the blocks, and the sets that ask in them."""
    dealt = scratch.store(dealt_sets(crowds))
    there = dealt.groupBy("cell", "block", "band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    near = F.col("band").between(band(F.col("n") * 0.79), band(F.col("n") * 1.26))
    apart = (F.col("low") < F.col("label")) | (F.col("label") < F.col("high"))
    asked = crowds.filter("label <> main").join(there, "cell").filter(near & apart)
    asked = scratch.store(asked.groupBy("block", "sid", "n", "label").agg(F.collect_list("cell").alias("cells")))
    slices = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("slices"))
    names = ["block", "slice", "asks", "sid", "n", "label", "point", "cells"]
    point = points.select("sid", "point")
    held = dealt.groupBy("block", "sid", "n", "label").agg(F.collect_list("cell").alias("cells")).join(slices, "block").join(point, "sid")
    held = held.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).withColumn("asks", F.lit(False))
    asking = asked.join(slices, "block").join(point, "sid").withColumn("slice", F.pmod(F.xxhash64("sid", F.lit(1)), "slices")).withColumn("asks", F.lit(True))
    return held.select(*names).unionByName(asking.select(*names))


def crowd_pairs(crowds: DataFrame, points: DataFrame, most: int, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(a, b): what the trees find, under other labels, for each set outside of the largest label of a cell, the ``most`` best
    of each label; and whether there is more."""
    best = Window.partitionBy("q", "label").orderBy(F.desc("bound"), "x")
    found = scratch.store(block_pairs(crowd_rows(crowds, points, scratch), most).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most + 1))
    pairs = found.filter(F.col("rank") <= most).select(F.least("q", "x").alias("a"), F.greatest("q", "x").alias("b")).distinct()
    return pairs, found.filter(F.col("rank") > most).limit(1).count() > 0


def needed_texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(sid, text) of the needed sets (sid, rep), one document each; a bitmap of fixed size keeps other texts from the shuffle."""
    bitmap = Bitmap(needed.select("rep"))
    listed = docs.filter("doc_id is not null").select("doc_id", "text", bit_of(F.col("doc_id")).alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(b.filter(pa.array(bitmap.holds(b.column("bit")))) for b in batches):
            sids = [fingerprint(s)[0] if len(s) else 0 for s in document_sets(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(sids, pa.int64()), piece.column("text")], ["rep", "sid", "text"])

    return listed.mapInArrow(run, "rep long, sid long, text string").join(needed, ["rep", "sid"]).dropDuplicates(["sid"]).select("sid", "text")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose whole sets reach 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(iter([batch]), "a_text", 1_000_000):
                left, right = document_sets(piece.column("a_text")), document_sets(piece.column("b_text"))
                common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)])
                union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)]) - common
                yield piece.select(["a", "b"]).filter(pa.array(100 * common >= 80 * union))

    side = lambda name: texts.select(F.col("sid").alias(name), F.col("text").alias(f"{name}_text"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def set_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, hi, lo, component (null where there is no shingle or doc_id) and keeper, the set (hi) of
    the component that its smallest doc_id has. Components are of sets, so rows of one doc_id with other texts stay apart."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.store(measured(docs))
    texts_of = rows.filter("cell is null")
    sets = scratch.store(texts_of.filter("doc_id is not null and n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.first("point").alias("point")))
    members = scratch.store(cells(rare_shingles(docs, rarity(rows))))
    points = sets.select(F.col("hi").alias("sid"), "n", "point", "rep")
    def links(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(points.select("sid", "rep"), "sid")
        return scratch.store(verified(pairs, scratch.store(needed_texts(docs, scratch.store(ids)))))

    tried = scratch.store(bounded_pairs(first_pairs(members), points))
    found = links(tried)
    labels = components(found, scratch)
    most, further = 2, True
    while further:  # the likeliest pairs of sets still apart, then more of them, until all were tried
        known = points.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "n", F.coalesce("label", "sid").alias("label"))
        labelled = scratch.store(members.join(known, "sid"))
        counts = labelled.groupBy("cell", "label").agg(F.count("*").alias("k"))
        split = counts.groupBy("cell").agg(F.sum("k").alias("k"), F.count("*").alias("labels"), F.max(F.struct("k", "label"))["label"].alias("main"))
        crowds = scratch.store(labelled.join(split.filter((F.col("k") > CROWD) & (F.col("labels") > 1)).select("cell", "main", "k"), "cell"))
        if not crowds.limit(1).count():
            break
        more, cut = crowd_pairs(crowds, points, most, scratch)
        more = scratch.store(more.join(tried, ["a", "b"], "left_anti"))
        if more.limit(1).count():
            tried = scratch.store(tried.unionByName(more))
            found = scratch.store(found.unionByName(links(more)))
            labels = components(found, scratch)
        most, further = most * MORE, cut
    labelled = sets.select("hi", "lo", "n", "rep").join(labels.withColumnRenamed("node", "hi"), "hi", "left").withColumn("label", F.coalesce("label", "hi"))
    first = labelled.groupBy("label").agg(F.min(F.struct("rep", "hi")).alias("first"))
    named = labelled.join(first, "label").select("hi", "lo", "n", F.col("first.rep").alias("component"), F.col("first.hi").alias("keeper"))
    joined = texts_of.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo", "n"], "left")
    known = lambda name: F.when(F.col("doc_id").isNotNull(), F.col(name)).alias(name)
    return joined.select("doc_id", "n", "hi", "lo", known("component"), known("keeper"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    found = set_components(docs)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").cast("long").alias("component_id"))


def with_sets(docs: DataFrame, near: Bitmap, names: list[str]) -> DataFrame:
    """The documents whose doc_id seems to be in a set and, under three new names, n, hi and lo of their shingles."""
    place = "bit_of_id_" + uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = (b.filter(pa.array(near.holds(b.column(place)))).drop_columns([place]) for b in batches)
        for piece in pieces(inside):
            sets = document_sets(piece.column("text"))
            prints = [fingerprint(s) for s in sets]
            numbers = [[len(s) for s in sets], [x for x, _ in prints], [x for _, x in prints]]
            yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(x, pa.int64()) for x in numbers)], [*piece.schema.names, *names])

    schema = docs.schema
    for name in names:
        schema = StructType([*schema.fields, StructField(name, LongType())])
    bit = F.when(F.col("doc_id").isNotNull(), bit_of(F.col("doc_id")))
    return docs.withColumn(place, bit).mapInArrow(run, schema)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, but of each component only the one that gives it its id.

    Each row is judged by its own set: a doc_id loses the rows that are copies and keeps the others. Rows of one doc_id and set (or text
    without a shingle) count as copies. Rows of a null doc_id link nothing and stay. Only rows that a bitmap of the ids with a dropped or
    repeated row lets through are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "one")
    found = scratch.store(set_components(docs))
    names = [f"{x}_of_set_{uuid.uuid4().hex}" for x in ("n", "hi", "lo")]
    copies = scratch.store(found.filter("doc_id <> component OR hi <> keeper").select("doc_id", *[F.col(x).alias(y) for x, y in zip(("n", "hi", "lo"), names, strict=True)]).distinct())
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    near = Bitmap(copies.select("doc_id").unionByName(repeated))
    rest = with_sets(docs, near, names).join(copies.hint("shuffle_hash"), ["doc_id", *names], "left_anti")
    if repeated.limit(1).count():
        text = "text_of_set_" + uuid.uuid4().hex
        rest = rest.withColumn(text, F.when(F.col(names[0]) == 0, F.col("text"))).dropDuplicates(["doc_id", *names, text])
    # what was shuffled is written in a job of its own; the result then only reads
    rest = scratch.store(rest.select(*[F.col(f"`{c}`") for c in docs.columns]))
    return near.rows(docs, False).unionByName(rest)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
named AS (SELECT s.r, s.g FROM shingles s JOIN worded d ON d.r = s.r WHERE d.doc_id IS NOT NULL),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM named x JOIN named y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM edges UNION SELECT node, b FROM reach JOIN edges ON other = a),
least_of AS (SELECT node, min(doc_id) AS m FROM reach JOIN worded ON r = other GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN d.doc_id IS NOT NULL THEN least(d.doc_id, coalesce(m, d.doc_id)) END AS component_id
FROM worded d LEFT JOIN sizes s ON s.r = d.r LEFT JOIN least_of l ON l.node = d.r
"""
