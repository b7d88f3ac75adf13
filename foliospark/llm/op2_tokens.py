"""Token counts of whole texts, huge texts by overlapping chunks that are spliced where both sides agree.

A pre-tokenizer that scans from left to right has no memory: from a common boundary on, two scans of the same text go
on alike, as long as the cut at a chunk's end is out of sight. So a boundary that both of two overlapping chunks have,
at least ``MARGIN`` characters (more than any special string or look-ahead) from their cut ends, is proven stable: the
left chunk counts up to it and the right chunk from it. Where an overlap holds no common boundary (a long run without
one) the left chunk is encoded again with its overlap doubled, up to the whole rest of the text.

The same holds within other texts: byte-level pre-tokens never go from a character that is no white space to white
space, nor from a letter to a mark. The stretches between such places count separately, and each worker remembers the
counts of up to ``MEMORY`` stretches that the library gave. Texts that hold a special string are encoded whole. Both
hold for a tokenizer without normalizer and with the byte-level pre-tokenizer and its pattern only, which is read from
the file; any other one encodes whole texts.

Null and empty texts have 0 bytes and 0 tokens. Rows are independent, so copies, ties and extra columns change nothing.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.shared import documents, pieces

MARGIN = 64
MEMORY = 600_000
#: A run of letters up to white space or an ASCII mark, or else white space (as Unicode has it: Python adds 1C to 1F) and what follows it.
STRETCH = re.compile(r"[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[ \n!-&(-/:-@\[-`{-~])|[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def scans_bytes(told: dict) -> bool:
    """Whether a tokenizer cuts texts from left to right by the byte-level pattern, and changes nothing before that."""
    cutter = told["pre_tokenizer"] or {}
    return told["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]


def boundaries(encoding, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of an encoded chunk begin in the whole text, and how many tokens come before each."""
    words, offsets = encoding.word_ids, encoding.offsets
    change = [k for k in range(len(words)) if k == 0 or words[k] is None or words[k] != words[k - 1]]
    places = np.fromiter((offsets[k][0] for k in change), np.int64, len(change)) if change else np.zeros(0, np.int64)
    return places + start, np.asarray(change, np.int64)


def spliced_count(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text``, encoded in chunks of ``chunk`` characters with overlaps of ``overlap`` that grow where needed."""
    n, total = len(text), 0

    def encoded(start: int, stop: int) -> tuple[int, np.ndarray, np.ndarray]:
        encoding = tokenizer.encode(text[start:stop], add_special_tokens=False)
        return len(encoding), *boundaries(encoding, start)

    start, stop, begun, wide = 0, min(n, chunk + overlap), 0, overlap  # the left chunk, where its count begins, its overlap
    size, places, before = encoded(start, stop)
    while stop < n:
        right = stop - wide
        right_stop = min(n, max(right + chunk, stop) + overlap)
        right_size, right_places, right_before = encoded(right, right_stop)
        seen = places[(places >= max(begun, right + MARGIN)) & (places <= stop - MARGIN)]
        common = np.intersect1d(seen, right_places)
        if not len(common):
            stop = min(n, stop + wide)
            wide = stop - right
            size, places, before = encoded(start, stop)
            continue
        total += int(before[np.searchsorted(places, common[0])] - before[np.searchsorted(places, begun)])
        start, stop, begun, wide = right, right_stop, int(common[0]), overlap
        size, places, before = right_size, right_places, right_before
    return total + size - int(before[np.searchsorted(places, begun)]) if size else total


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, huge: int = 65_536, chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """One row per document: bytes, tokens by the library for ``tokenizer`` (.json or .model), and whether over ``limit``.

    Texts over ``huge`` characters go by chunks; a sentencepiece model, whose pieces may cross any white space, and any
    tokenizer that does not scan bytes encode whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            counts = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer)

            special = [x.content for x in model.get_added_tokens_decoder().values()]
            scans = scans_bytes(json.loads(model.to_str())) and max(map(len, special), default=0) < MARGIN
            known: dict[str, int] = {}

            def whole(text: str) -> int:
                return spliced_count(model, text, chunk, overlap) if scans and len(text) > huge else len(model.encode(text, add_special_tokens=False))

            def counts(texts: list[str]) -> list[int]:
                plain = [scans and len(x) <= huge and not any(s in x for s in special) for x in texts]
                found = [STRETCH.findall(x) if p else () for x, p in zip(texts, plain, strict=True)]
                new = list({x for parts in found for x in parts if x not in known})
                if len(known) + len(new) > MEMORY:
                    known.clear()
                    new = list({x for parts in found for x in parts})
                for k in range(0, len(new), 10_000):
                    some = new[k : k + 10_000]
                    known.update(zip(some, map(len, model.encode_batch_fast(some, add_special_tokens=False)), strict=True))
                return [sum(map(known.__getitem__, parts)) if p else whole(x) for x, parts, p in zip(texts, found, plain, strict=True)]

        for piece in pieces(batches, size=500_000):
            texts = [x or "" for x in piece.column("text").to_pylist()]
            n_tokens = np.asarray(counts(texts), np.int64)
            n_bytes = np.asarray([len(x.encode()) for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
