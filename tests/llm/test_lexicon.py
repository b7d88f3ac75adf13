"""Ids and decoded texts against the library, the automaton against its words."""

import hashlib
import json
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliospark.llm.op12_lexicon import Cutter, Lexicon, Vocabulary, byte_characters, compiled, digests, encoded, frequent_words, packed, texts_of
from foliospark.llm.shared import text_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = Vocabulary(PATH)
ODD = ["<|endoftext|>", "<|endof", "a", "I'll", "don't", "'", "''", "'ve", "'res", "'S", "'é", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "é", "Ñandú", "!", "?!", "123", "٣", "½", "你好", "🙂", "'s", "x×y", "_", "-", "…", "​", "՘", "\U00032000", "é"]


def odd_texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) if rng.random() < 0.8 else rng.choice(ODD) * rng.randint(1, 9) for _ in range(rng.randint(0, most))) for _ in range(n)]


def plain(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    back = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@pytest.mark.parametrize("most", [0, 5, 262_144])
def test_texts_of_any_kind(documents_of, small_batches, most):
    texts = odd_texts(400, 40, most) + [None, "", " ", "word " * 3000, "a" * 3000, "ab" * 400, "\n" * 2000, "<|endoftext|>" * 50]
    rows = [*enumerate(texts), (3, "twice"), (3, "twice"), (None, "no id"), (-1, None)]
    got = [tuple(r) for r in digests(documents_of(rows), PATH, most).collect()]
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(got, key=key) == sorted([(k, *plain(t)) for k, t in rows], key=key)


def test_cuts():
    import pyarrow as pa

    cutter = Cutter(PATH, {})
    for text in odd_texts(500, 30, 7):
        data, bounds = text_bytes(pa.array([text]))
        want = [len(text[:a].encode()) for _, (a, _) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
        # characters of several bytes may count as one each in the library's places
        assert cutter.starts(data, bounds).tolist() == want, repr(text)


def test_kinds_of_all_characters():
    """Each character between others, cut as the library does."""
    import pyarrow as pa

    cutter = Cutter(PATH, {})
    codes = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(codes), 8192):
        text = "".join(f"a{chr(c)}1 {chr(c)}!" for c in codes[k : k + 8192])
        places = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
        want = places[[a for _, (a, _) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]]
        data, bounds = text_bytes(pa.array([text]))
        assert np.array_equal(cutter.starts(data, bounds), want)


def test_merges():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeth inglo") for _ in range(rng.randint(1, 70))).encode() for _ in range(500)]
    words += [b"a" * k for k in range(1, 90)] + ["é你🙂".encode() * 3, b"\xff\xfe", b"e" * 5000]
    of = {c: b for b, c in enumerate(byte_characters())}
    want = [[t.id for t in LIBRARY.model.tokenize("".join(c for b in w for c, x in of.items() if x == b))] for w in words]
    assert VOCABULARY.merged(words) == want
    assert [VOCABULARY.merged_long(w) for w in words] == want
    assert VOCABULARY.merged([]) == []


def test_automaton_is_exact_and_minimal(tmp_path):
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 6))) for _ in range(600)} | {b"x" * 32})
    arrays = compiled(words, [[k, k + 1] for k in range(len(words))])
    path = tmp_path / "lexicon"
    path.write_bytes(packed(arrays))
    lexicon = Lexicon(str(path))
    assert isinstance(lexicon.target, np.memmap)
    asked = words + [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 8))) for _ in range(2000)] + [b"x" * 31, b"x" * 33]
    sizes = np.array([len(w) for w in asked])
    got = lexicon.numbers(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [words.index(w) if w in words else -1 for w in asked]
    # states are as many as there are different sets of endings
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(arrays["first"]) == len(endings)


def test_empty_lexicon(tmp_path):
    path = tmp_path / "lexicon"
    path.write_bytes(packed(compiled([], [])))
    assert Lexicon(str(path)).numbers(np.frombuffer(b"abc", np.uint8), np.array([0, 1]), np.array([1, 2])).tolist() == [-1, -1]


def test_frequent_words(documents_of):
    docs = documents_of([(1, "the the the the the cat"), (2, "the cat"), (3, None), (4, "x" * 40)])
    assert frequent_words(docs, PATH, 2) == [b" the"]  # the next level has two words
    assert frequent_words(docs, PATH, 3) == sorted([b" the", b"the", b" cat"])
    assert frequent_words(docs, PATH, 0) == []


def test_round_trip(documents_of, small_batches):
    texts = odd_texts(60, 30, 11) + [None, ""]
    back = texts_of(encoded(documents_of(list(enumerate(texts))), PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(texts)}


def test_decoding_of_any_ids(spark):
    rng = random.Random(6)
    rows = [[rng.randrange(50257) for _ in range(rng.randint(0, 30))] for _ in range(300)]
    df = spark.createDataFrame([*enumerate(rows), (999, None)], "doc_id long, ids array<int>")
    want = {k: LIBRARY.decode(r, skip_special_tokens=False) for k, r in enumerate(rows)}
    assert {r.doc_id: r.text for r in texts_of(df, PATH).collect()} == {**want, 999: ""}


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    told = json.load(open(PATH, encoding="utf-8"))
    told["model"]["merges"] = told["model"]["merges"][::-1]
    path = tmp_path / "reversed.json"
    path.write_text(json.dumps(told))
    with pytest.raises(ValueError):
        Vocabulary(str(path))


def test_empty_table(documents_of):
    assert digests(documents_of([]), PATH).count() == 0
