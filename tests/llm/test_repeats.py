"""Removed bytes against a dictionary of all strings."""

import hashlib
import random

import pytest

from foliospark.llm.op3_repeats import remove_repeats


def brute(rows, length=100):
    first, out = {}, {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], (i, k))
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] != (i, k):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i, text] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    fresh = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(n))
    shared = [fresh(rng.randint(8, 60)) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else fresh(rng.randint(0, 30)) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.3 and parts:
            cut = rng.randint(0, len(parts[0]))
            parts[0] = parts[0][cut:] + "!" + parts[0][:cut]
        out.append(" ".join(parts))
    return out + ["x" * 350, "x" * 99, "x" * 100, "x" * 101, "ab" * 200, "abc" * 80 + "ab" * 120, "", None, shared[0], shared[0], "é" * 120]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_strings(documents_of, small_batches, seed):
    rng = random.Random(seed)
    rows = list(enumerate(texts(seed)))
    rng.shuffle(rows)
    rows = [(i - 30, t) for i, t in rows]
    got = {(r.doc_id, r.text): r for r in remove_repeats(documents_of(rows)).join(documents_of(rows).select("doc_id", "text"), "doc_id").collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for key, r in got.items():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[key]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_crowds_of_edges(documents_of, small_batches):
    passage = "the same passage of more than one hundred bytes stands in every one of these many documents, with other words around it"
    rng = random.Random(5)
    noise = lambda: "".join(rng.choice("qwertyuiop ") for _ in range(rng.randint(0, 90)))
    rows = [(k, f"{noise()}{passage}{noise()}") for k in range(80)] + [(200 + k, f"{noise()}{passage}") for k in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(documents_of(rows)).collect()}
    assert got == {i: v for (i, _), v in brute(rows).items()}


def test_rows_of_one_id_null_ids_and_empty_tables(documents_of):
    text = "repeated text " * 20 + "end of a text that is long enough to hold strings"
    rows = [(None, text), (5, text), (5, text), (9, text)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in remove_repeats(documents_of(rows)).collect())
    own = brute([(None, text)])[None, text][1]
    assert got == [(False, 0, own), (True, 5, len(text)), (True, 5, len(text)), (True, 9, len(text))]
    assert remove_repeats(documents_of([])).count() == 0


def test_rows_without_an_id_stay_apart(documents_of):
    """Some thousand texts of one id each keep their own places: no short hash of the text stands for it."""
    passage = "this passage of more than one hundred bytes stands once in each of two texts, one with an id and one that has none at all; "
    alone = [f"{k} " + " ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest() for j in range(2 + k % 4)) for k in range(3000)]
    rows = [(None, t + passage + str(k) if k == 7 else t) for k, t in enumerate(alone)] + [(5, passage + t) for t in ("one", "two")]
    got = {r.kept_sha256: r for r in remove_repeats(documents_of(rows)).collect()}
    want = {hashlib.sha256(t.encode()).hexdigest() for i, t in rows if i is None}
    assert want <= set(got) and all(got[k].n_removed == 0 for k in want)
    doubled = [(None, t + " " + t) for t in alone[:2000]]
    out = remove_repeats(documents_of(doubled)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(brute_alone(t) for _, t in doubled)


def brute_alone(text):
    return brute([(0, text)])[0, text]
