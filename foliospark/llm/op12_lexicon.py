"""Byte-level BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

Spark counts the words (pre-tokens) of all texts. The most frequent ``WORDS`` at most of up to ``LONGEST`` bytes are merged
once and compiled into the smallest acyclic automaton that accepts them: words share their beginnings and, by a
register of equal states, their ends. Each arc has an output, and the outputs along a word add up to its number, whose
row in a table holds its ids. The compiled file is written to the shared folder, Spark hands it to the executors, and
workers map it into memory. A task walks all distinct words of a piece at once, a byte a step. Words that the lexicon
doesn't hold are merged exactly: short ones together, the lowest rank of each word first, long ones by a heap of ranks.
So the bound of the lexicon changes no id.

Texts are cut by the rules of the byte-level pre-tokenizer, on arrays of bytes; to which kind (letter, number, white
space, other) a character belongs is asked from the library, once per character and task. Added tokens that stand in a
text become their id, as in the library. A tokenizer file with any other normalizer, pre-tokenizer, model option or
kind of added token is refused.

Null and empty texts have no ids and decode to the empty text. Rows are independent: ties, copies and extra columns
change nothing. Memory grows with the longest text only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import Scratch, documents, pieces, text_bytes
from foliospark.sources.io import stored_folder

WORDS, LONGEST = 262_144, 32
#: Words of up to so many bytes are merged together, longer ones one by one.
SHORT = 64
#: A task remembers the ids of so many words that the lexicon doesn't hold.
MEMORY = 200_000
LETTER, NUMBER, OTHER, SPACE, ADDED, UNKNOWN = range(6)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def gathered(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... for each stretch k."""
    ends = np.cumsum(counts)
    return np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """The bytes of each id, and the rank and result of each pair of ids that merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, cutter = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        plain &= told["normalizer"] is None and cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"] and cutter.get("use_regex", True)
        plain &= (told["decoder"] or {}).get("type") == "ByteLevel"
        plain &= not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in told["added_tokens"])
        if not plain:
            raise ValueError(f"{path} is no plain byte-level BPE")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.added = {x["content"].encode(): x["id"] for x in told["added_tokens"]}
        ids = model["vocab"]
        tokens = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for text, k in [*ids.items(), *((x["content"], x["id"]) for x in told["added_tokens"])]:
            tokens[k] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
        self.tokens = tokens
        self.single = np.array([ids[c] for c in byte_characters()], np.int64)
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if a + b in made or any(len(x) > 1 and x not in made for x in (a, b)):
                raise ValueError(f"{path}: merges are not in the order in which their parts are made")
            made[a + b] = rank
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.wide = len(tokens)
        keys = np.array([a * self.wide + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.results = np.array([x for _, x in self.merges.values()], np.int64)  # by rank

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each begins."""
        sizes = np.array([len(x) for x in self.tokens], np.int64)
        return np.frombuffer(b"".join(self.tokens), np.uint8), np.concatenate(([0], np.cumsum(sizes)))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges if it doesn't merge."""
        key = a * self.wide + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merged_long(self, word: bytes) -> list[int]:
        """Ids of one word: the lowest rank first, from the left, by a heap of ranks and places."""
        ids: list[int | None] = [int(self.single[b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        known = self.merges
        heap = [(known[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in known]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            if ids[k] is None or right >= len(ids):
                continue
            found = known.get((ids[k], ids[right]))
            if found is None or found[0] != rank:
                continue
            ids[k], ids[right] = found[1], None
            after[k] = after[right]
            if after[k] < len(ids):
                before[after[k]] = k
                if (pair := (ids[k], ids[after[k]])) in known:
                    heapq.heappush(heap, (known[pair][0], k))
            if before[k] >= 0 and (pair := (ids[before[k]], ids[k])) in known:
                heapq.heappush(heap, (known[pair][0], before[k]))
        return [x for x in ids if x is not None]

    def merged_short(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of words, each round merging the pair of lowest rank of each word wherever it stands.

        That is exact because parts are made before they merge: what a merge brings next to a part has a higher rank."""
        out: list[list[int]] = [[]] * len(words)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids, word = self.single[data], np.repeat(np.arange(len(words)), [len(x) for x in words])
        while len(ids):
            rank = np.full(len(ids), len(self.keys))
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self.rank_of(ids[inside], ids[inside + 1])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            done = least == len(self.keys)
            ended = np.repeat(done, size)
            if done.any():
                row, at = ids[ended].tolist(), 0
                for k, n in zip(word[first[done]].tolist(), size[done].tolist(), strict=True):
                    out[k] = row[at : at + n]
                    at += n
            hit = (rank == np.repeat(least, size)) & ~ended
            place = np.flatnonzero(hit)
            begin = np.concatenate(([True], np.diff(place) > 1)) if len(place) else np.zeros(0, bool)
            run = np.repeat(place[begin], np.diff(np.append(np.flatnonzero(begin), len(place))))
            place = place[(place - run) % 2 == 0]  # of overlapping pairs every other one, from the left
            ids[place] = self.results[rank[place]]
            keep = ~ended
            keep[place + 1] = False
            ids, word = ids[keep], word[keep]
        return out

    def merged(self, words: Sequence[bytes]) -> list[list[int]]:
        short = [k for k, x in enumerate(words) if len(x) <= SHORT]
        out = [self.merged_long(x) if len(x) > SHORT else [] for x in words]
        for k, ids in zip(short, self.merged_short([words[k] for k in short]), strict=True):
            out[k] = ids
        return out


def compiled(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> dict[str, np.ndarray]:
    """The transducer of sorted, distinct words as arrays.

    A state's arcs are numbered from ``first``, in the order of their bytes; ``labels`` has 256 bits a state, and
    ``before`` how many are set in earlier words of them. The last state is the root. Words are added in order; the
    states of the last word that the next one doesn't share are final in form, and an equal one is taken if there is one.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, bytes, tuple[int, ...]]] = []
    path: list[tuple[list[bool], bytearray, list[int]]] = [([False], bytearray(), [])]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            end, labels, targets = path.pop()
            form = (end[0], bytes(labels), tuple(targets))
            if form not in register:
                register[form] = len(states)
                states.append(form)
            path[-1][2].append(register[form])

    last = b""
    for word in words:
        same = next((k for k, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        close(same)
        for b in word[same:]:
            path[-1][1].append(b)
            path.append(([False], bytearray(), []))
        path[-1][0][0] = True
        last = word
    close(0)
    states.append((path[0][0][0], bytes(path[0][1]), tuple(path[0][2])))
    below, first, target, output = [], [], [], []
    labels = np.zeros((len(states), 4), np.uint64)
    for k, (end, bytes_, targets) in enumerate(states):
        first.append(len(target))
        count = int(end)
        for b, t in zip(bytes_, targets, strict=True):
            labels[k, b >> 6] |= np.uint64(1 << (b & 63))
            target.append(t)
            output.append(count)
            count += below[t]
        below.append(count)
    before = np.zeros((len(states), 4), np.uint8)
    before[:, 1:] = np.cumsum(np.bitwise_count(labels[:, :3]), 1)
    sizes = [len(x) for x in ids]
    return {
        "labels": labels.ravel(),
        "before": before.ravel(),
        "first": np.array(first, np.uint32),
        "final": np.array([s[0] for s in states], np.uint8),
        "target": np.array(target, np.uint32),
        "output": np.array(output, np.uint32),
        "row": np.concatenate(([0], np.cumsum(sizes))).astype(np.uint32),
        "ids": np.array([x for row in ids for x in row], np.uint32),
    }


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a line that names the arrays, and each of them from a place divisible by 8."""
    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in arrays.items()}).encode() + b"\n"
    out = bytearray(head)
    for v in arrays.values():
        out += bytes(-len(out) % 8) + v.tobytes()
    return bytes(out)


class Lexicon:
    """A compiled file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            head = file.readline()
        at, arrays = len(head), {}
        for name, (kind, size) in json.loads(head).items():
            at += -at % 8
            arrays[name] = np.memmap(path, np.dtype(kind), "r", at, (size,)) if size else np.zeros(0, kind)
            at += size * np.dtype(kind).itemsize
        self.__dict__ |= arrays

    def numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if the lexicon doesn't hold it; all words go a byte a step."""
        number = np.zeros(len(starts), np.int64)
        state = np.full(len(starts), len(self.first) - 1, np.int64)
        state[sizes > LONGEST] = -1
        for step in range(min(LONGEST, int(sizes.max(initial=0)))):
            alive = np.flatnonzero((sizes > step) & (state >= 0))
            byte, at = data[starts[alive] + step].astype(np.int64), state[alive]
            part = at * 4 + (byte >> 6)
            bits, bit = self.labels[part], (byte & 63).astype(np.uint64)
            arc = self.first[at].astype(np.int64) + self.before[part] + np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
            there = (bits >> bit) & np.uint64(1) == 1
            state[alive[~there]] = -1
            alive, arc = alive[there], arc[there]
            state[alive] = self.target[arc]
            number[alive] += self.output[arc]
        return np.where((state >= 0) & (self.final[state] == 1), number, -1)


class Cutter:
    """Cuts texts as the byte-level pre-tokenizer does."""

    def __init__(self, path: str, added: dict[bytes, int]):
        from tokenizers import Tokenizer

        self.asked = Tokenizer.from_file(path).pre_tokenizer
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind_of(np.arange(128))
        long_first = sorted(added, key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, long_first))) if added else None

    def kind_of(self, codes: np.ndarray) -> np.ndarray:
        """Kinds of characters. A character is of the kind of the one before if the library does not cut between them."""
        new = np.unique(codes[self.kinds[codes] == UNKNOWN])
        if len(new):
            found = np.full(len(new), SPACE, np.uint8)
            for lead, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
                cuts = np.array([a for _, (a, _) in self.asked.pre_tokenize_str("".join(lead + chr(c) for c in new))])
                found[~np.isin(2 * np.arange(len(new)) + 1, cuts)] = kind
            self.kinds[new] = found
        return self.kinds[codes]

    def byte_kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of each byte's character."""
        if not len(data) or data.max() < 128:
            return self.kinds[data]
        lead = (data & 0xC0) != 0x80
        place = np.flatnonzero(lead)
        code = data[place].astype(np.int64)
        size = 1 + (code >= 0xC0) + (code >= 0xE0) + (code >= 0xF0)
        code &= np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[size]
        for k in (1, 2, 3):
            some = np.flatnonzero(size > k)
            code[some] = (code[some] << 6) | (data[place[some] + k] & 0x3F)
        return np.repeat(self.kind_of(code), size)

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where words and added tokens begin; every byte is in one of them."""
        n = len(data)
        kind = self.byte_kinds(data)
        fresh = np.zeros(n + 1, bool)  # texts, and what stands around added tokens, are cut on their own
        fresh[bounds] = True
        if self.added is not None:
            for found in self.added.finditer(data.tobytes()):
                a, b = found.span()
                if np.searchsorted(bounds, a, "right") == np.searchsorted(bounds, b, "left"):
                    kind[a:b] = ADDED
                    fresh[[a, b]] = True
        begin = fresh[:-1].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        # white space before something else: its last character goes with what follows if it is a space, else by itself
        after = np.flatnonzero(begin & ~fresh[:-1])
        after = after[kind[after - 1] == SPACE]
        last = after - 1
        spaced = data[last] == 0x20
        begin[after[spaced]] = False
        for _ in range(3):
            last -= (data[last] & 0xC0) == 0x80
        begin[last] = True
        # a mark by itself and the letters of a short form
        mark = np.flatnonzero((data == 0x27) & begin[:n])
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == LETTER) & ~fresh[mark + 1]]
        one = data[mark + 1]
        two = np.where((mark + 2 < n) & ~fresh[np.minimum(mark + 2, n)], data[np.minimum(mark + 2, n - 1)], 0)
        single = np.isin(one, list(b"stmd"))
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        mark, size = mark[single | double], np.where(single, 1, 2)[single | double]
        begin[mark + 1] = False
        end = mark + 1 + size
        begin[end[end < n]] = True
        return np.flatnonzero(begin)


def words_of(cutter: Cutter, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.LargeBinaryArray]:
    """Bytes of all texts, their bounds, and where the words begin, which are also given as an Arrow array without a copy."""
    data, bounds = text_bytes(column)
    starts = cutter.starts(data, bounds)
    ends = np.append(starts, len(data)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return data, bounds, starts, words


def frequent_words(docs: DataFrame, tokenizer: str, most: int = WORDS) -> list[bytes]:
    """The most frequent words of up to ``LONGEST`` bytes of all texts: ``most`` at most, by whole levels of their counts (16 for each doubling)."""
    added = Vocabulary(tokenizer).added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(tokenizer, added)
        for piece in pieces(batches):
            words = words_of(cutter, piece.column("text"))[3]
            counted = words.filter(pc.less_equal(pc.binary_length(words), LONGEST)).value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.binary()), counted.field("counts")], ["word", "count"])

    scratch = Scratch(docs.sparkSession, "op12")
    counted = docs.select("text").mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))
    counted = scratch.store(counted.withColumn("level", F.floor(16 * F.log2("count"))))
    levels = counted.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # 1,024 at most
    room, least = most, None
    for level, n in levels:
        room -= n
        if room < 0:
            break
        least = level
    words = [] if least is None else [bytes(r[0]) for r in counted.filter(F.col("level") >= least).select("word").collect()]
    scratch.drop(counted)
    return sorted(set(words) - set(added))


def built(spark: SparkSession, words: Sequence[bytes], vocabulary: Vocabulary) -> str:
    """Compile a lexicon, write it to the shared folder, have Spark hand it to the executors; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{stored_folder(spark)}/llm/{name}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(path)
    out.write(bytearray(packed(compiled(words, vocabulary.merged(words)))))
    out.close()
    spark.sparkContext.addFile(system.makeQualified(path).toString())
    return name


class Encoder:
    """Ids of the texts of Arrow columns, inside a task."""

    def __init__(self, tokenizer: str, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.cutter = Cutter(tokenizer, vocabulary.added)
        self.known: dict[bytes, list[int]] = {k: [v] for k, v in vocabulary.added.items()}

    def others(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words outside of the lexicon."""
        new = [x for x in words if x not in self.known]
        found = dict(zip(new, self.vocabulary.merged(new), strict=True))
        out = [found[x] if x in found else self.known[x] for x in words]
        if len(self.known) + len(new) > MEMORY:
            self.known = {k: [v] for k, v in self.vocabulary.added.items()}
        self.known |= {k: v for k, v in found.items() if len(k) <= SHORT}
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 places where the texts' ids begin."""
        _, bounds, starts, words = words_of(self.cutter, column)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        place = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        lexicon = self.lexicon
        number = lexicon.numbers(data, place[:-1], np.diff(place))
        unseen = np.flatnonzero(number < 0)
        rows = self.others(distinct.take(pa.array(unseen)).to_pylist())
        number[unseen] = len(lexicon.row) - 1 + np.arange(len(unseen))
        row = np.concatenate((lexicon.row.astype(np.int64), len(lexicon.ids) + np.cumsum([len(x) for x in rows], dtype=np.int64)))
        table = np.concatenate((lexicon.ids, np.array([x for r in rows for x in r], np.uint32)))
        number = number[coded.indices.to_numpy(zero_copy_only=False)]
        counts = row[number + 1] - row[number]
        ids = table[gathered(row[number], counts)]
        return ids, np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, bounds)]


def decoded(ids: np.ndarray, bounds: np.ndarray, flat: np.ndarray, place: np.ndarray) -> list[bytes]:
    """The texts that ids stand for, as UTF-8; bytes that are none become replacement characters."""
    sizes = (place[1:] - place[:-1])[ids]
    whole = flat[gathered(place[:-1][ids], sizes)].tobytes()
    at = np.concatenate(([0], np.cumsum(sizes)))[bounds].tolist()
    return [whole[a:b].decode("utf-8", "replace").encode() for a, b in zip(at[:-1], at[1:], strict=True)]


def encoded(docs: DataFrame, tokenizer: str, most: int = WORDS) -> DataFrame:
    """doc_id and the ids of each text."""
    vocabulary = Vocabulary(tokenizer)
    name = built(docs.sparkSession, frequent_words(docs, tokenizer, most), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, vocabulary, Lexicon(SparkFiles.get(name)))
        for piece in pieces(batches):
            ids, bounds = encoder(piece.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def texts_of(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text that each row's ids (null: none) stand for; added tokens are kept."""
    flat, place = Vocabulary(tokenizer).flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            texts = decoded(lists.flatten().to_numpy(zero_copy_only=False), bounds, flat, place)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str, most: int = WORDS) -> DataFrame:
    """One row per document: its number of ids, and digests of the ids and of the text that they decode to."""
    vocabulary = Vocabulary(tokenizer)
    flat, place = vocabulary.flat()
    name = built(docs.sparkSession, frequent_words(docs, tokenizer, most), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, vocabulary, Lexicon(SparkFiles.get(name)))
        for piece in pieces(batches):
            ids, bounds = encoder(piece.column("text"))
            whole, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            told = [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            texts = [hashlib.sha256(x).hexdigest() for x in decoded(ids, bounds, flat, place)]
            arrays = [piece.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(told, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op12_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
