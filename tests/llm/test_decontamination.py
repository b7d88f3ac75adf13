"""Exact phrases and proximity against plain Python, blocks of items, and the SQL."""

import hashlib
import random
import re

import pytest

import __spark_entry__ as entry
from foliospark.llm.op8_decontamination import decontamination, keep_clean
from queries.compare import check, duck

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def windows_of(items, width=10):
    out = {}
    for name, text in items:
        w = words_of(text)
        for k in range(max(len(w) - width + 1, 1) if w else 0):
            out.setdefault(tuple(w[k : k + width]), set()).add("" if name is None else str(name))
    return out


def brute(rows, items):
    windows, out = windows_of(items), {}
    for i, text in rows:
        w, hit, names = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= found
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def sample(seed):
    rng = random.Random(seed)
    words = ["the", "of", "A1", "b2", "é", "Où", "x", "zz", "in", "9"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "--", " | "]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 14, 30]))) for k in range(3, 20)] + [(3, text(12)), (None, "zz x zz x zz"), (40, None), (41, " -- ")]
    rows = []
    for k in range(60):
        parts = [text(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, len(w))
            parts += [" ".join(w[cut:]) if rng.random() < 0.5 else " ".join(w), text(rng.randint(0, 9))]
        rows.append((k, " ".join(parts)))
    return rows + [(70, None), (71, ""), (72, "word " * 40_000 + (items[0][1] or ""))], items


@pytest.fixture
def item_frame(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n", "'w' AS words", "0 AS doc_id")


@pytest.mark.parametrize("seed", range(3))
def test_exact_phrases(documents_of, item_frame, small_batches, seed):
    rows, items = sample(seed)
    got = {r.doc_id: tuple(r[1:6]) for r in decontamination(documents_of(rows), item_frame(items)).collect()}
    want = brute(rows, items)
    assert got == want
    kept = keep_clean(documents_of(rows), item_frame(items))
    assert {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if not v[4]} and kept.schema == documents_of(rows).schema


def test_many_blocks_give_the_same(documents_of, item_frame):
    rows, items = sample(7)
    got = {r.doc_id: tuple(r[1:6]) for r in decontamination(documents_of(rows), item_frame(items), block_words=25).collect()}
    assert got == brute(rows, items)


def test_proximity(documents_of, item_frame):
    """Up to two other words between the words of a phrase, against all ways to place them."""
    rng = random.Random(2)
    phrase = "k1 k2 k3 k4 k5 k6"
    rows = []
    for k in range(200):
        out = []
        for word in phrase.split():
            out += [word, *["o"] * (rng.random() < 0.25), *["k2"] * (rng.random() < 0.1)]
        if rng.random() < 0.2:
            out.remove("k4")
        rows.append((k, " ".join(["k1", *out, "k6"])))

    def near(text, slop):
        words, wanted = text.split(), phrase.split()
        for start in range(len(words)):
            at, good = start - 1, True
            for w in wanted:
                at = next((j for j in range(at + 1, len(words)) if words[j] == w), None)
                if at is None:
                    good = False
                    break
            if good and words[start] == wanted[0] and at - start + 1 <= len(wanted) + slop:
                return True
        return False

    for slop in (0, 2):
        got = {r.doc_id: r.n_near for r in decontamination(documents_of(rows), item_frame([(1, phrase)]), slop=slop).collect()}
        assert got == {i: int(near(t, slop)) for i, t in rows}


def test_odd_rows_and_empty_tables(documents_of, item_frame):
    rows = [(None, "x y"), (1, "X, y"), (1, "X, y"), (2, None)]
    got = sorted((str(r.doc_id), r.n_hit, r.n_items) for r in decontamination(documents_of(rows), item_frame([(5, "x y")])).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 0, 0), ("None", 2, 1)]
    assert decontamination(documents_of([]), item_frame([(5, "x y")])).count() == 0
    clean = decontamination(documents_of(rows), item_frame([])).collect()
    assert [r.contaminated for r in clean] == [False] * 4 and keep_clean(documents_of(rows), item_frame([])).count() == 4


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert check(spark, duck(sf), sf, entry.queries()["op8_decontamination"], entry.oracle_sql()["op8_decontamination"]) == ""
