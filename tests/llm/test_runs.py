"""Runs against every stretch and period, extensions against word-by-word comparison."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from foliospark.llm.op13_runs import Extensions, all_runs, run_list, word_runs


def plain_runs(words):
    """(start, length, period) of all runs, from the alike pairs of each period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items() if n >= max(6, 4 * q))


def plain_row(doc_id, text, plant):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    n = len(words)
    if plant and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def sequences(seed, many=60):
    rng = random.Random(seed)
    for _ in range(many):
        out = []
        while len(out) < rng.randint(0, 400):
            unit = [rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.randint(1, rng.choice([2, 5, 40])))]
            out += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        yield out


@pytest.mark.parametrize("seed", range(5))
def test_all_runs(seed):
    texts = list(sequences(seed)) + [[], [1], [3] * 5, [3] * 6, [1, 2] * 4, [1, 2] * 4 + [1], [7] * 2000]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    rows = all_runs(np.array(sum(texts, []), np.int64), first)
    for k, text in enumerate(texts):
        assert [tuple(r[1:]) for r in rows[rows[:, 0] == k].tolist()] == plain_runs(text), k


@pytest.mark.parametrize("kinds", [1, 2, 50])
def test_extensions(kinds):
    rng = np.random.default_rng(kinds)
    words = np.append(rng.integers(1, kinds + 1, 700), kinds + 1)
    words[300:500] = words[100:300]
    words[650:700] = words[50:100]
    i, j = rng.integers(0, 701, (2, 4000))
    i, j = i[i != j], j[i != j]
    want = [next(k for k in range(702) if max(a, b) + k > 700 or words[a + k] != words[b + k]) for a, b in zip(i, j, strict=True)]
    assert Extensions(words)(i, j).tolist() == want


def texts():
    rng = random.Random(9)
    out = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x " * 5000, "na na na hey " * 4, "one two\nthree\tone two three " * 30, "\x1c \x0b é é é é é é"]
    for t in sequences(3, 80):
        out.append("".join(f"w{x}" + rng.choice([" ", "\n", "  "]) for x in t))
    words = [f"v{rng.randint(0, 400)}" for _ in range(3000)]
    return [*out, " ".join(words), " ".join(words[:900] * 3 + words[:901])]


@pytest.mark.parametrize("plant", [False, True])
def test_rows(documents_of, small_batches, plant):
    rows = [*enumerate(texts()), (5, "b " * 9), (5, "b " * 9), (None, "c " * 7), (-3, None)]
    got = sorted(tuple(r) for r in word_runs(documents_of(rows), plant).collect() if r.doc_id is not None)
    assert got == sorted((k, *plain_row(k, t, plant)) for k, t in rows if k is not None)
    (null,) = [tuple(r[1:]) for r in word_runs(documents_of(rows), plant).collect() if r.doc_id is None]
    assert null == plain_row(None, "c " * 7, plant)


def test_run_list_and_empty_table(documents_of):
    assert [tuple(r) for r in run_list(documents_of([(4, "a b " * 5 + "c")])).collect()] == [(4, 0, 10, 2)]
    assert word_runs(documents_of([])).count() == 0 and run_list(documents_of([])).count() == 0
