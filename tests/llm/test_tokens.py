"""Counts against the library on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliospark.llm.op2_tokens import count_tokens, spliced_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["<|endoftext|>", "<|endof", "a", "I'll", "don't", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "é", "Ñandú", "!", "?!", "123", "٣", "你好", "🙂", "'s", "x×y", "_", "-", "…", "​"]


def whole(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def odd_texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) if rng.random() < 0.7 else rng.choice(ODD) * rng.randint(1, 9) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_texts_of_any_kind(documents_of):
    texts = odd_texts(400, 40, 1) + [None, "", " ", "word " * 5000, "a" * 3000, "\n" * 2000, "<|endoftext|>" * 50]
    texts += texts[:20]
    rows = count_tokens(documents_of(list(enumerate(texts))), PATH, limit=30).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {k: (len((t or "").encode()), whole(t), whole(t) > 30) for k, t in enumerate(texts)}


def test_huge_texts_are_spliced(documents_of):
    texts = ["".join(odd_texts(8, 300, k)) for k in range(12)] + ["b" * 9000, " " * 9000, "long words " * 900]
    rows = count_tokens(documents_of(list(enumerate(texts))), PATH, huge=1000, chunk=700, overlap=150).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: whole(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("seed", range(4))
def test_splices(seed):
    for text in odd_texts(60, 500, seed + 50):
        assert spliced_count(LIBRARY, text, 300, 140) == whole(text)


def test_sentencepiece(documents_of):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = count_tokens(documents_of([(1, "Hello  there\nyou"), (2, None)]), path).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {1: len(model.encode("Hello  there\nyou")), 2: len(model.encode(""))}


def test_empty_table(documents_of):
    assert count_tokens(documents_of([]), PATH).count() == 0


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True}}, {"pre_tokenizer": None}])
def test_other_tokenizers_encode_whole_texts(documents_of, tmp_path, change):
    import json

    told = json.load(open(PATH, encoding="utf-8")) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    other = Tokenizer.from_file(str(path))
    texts = [t for t in odd_texts(60, 20, 5)] + ["Some Long Words " * 100]
    rows = count_tokens(documents_of(list(enumerate(texts))), str(path), huge=500, chunk=300, overlap=100).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(other.encode(t, add_special_tokens=False)) for k, t in enumerate(texts)}
