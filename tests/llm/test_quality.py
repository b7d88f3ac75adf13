"""Trees on known functions, scores on labelled documents, and the rules' counts against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm.op4_quality import FEATURES, fit_trees, quality_scores, statistics, walk
from foliospark.llm.op9_rules import grams, keep_good, quality_rules
from foliospark.llm.shared import text_bytes

SF = "/root/testdata/sf0.01"


def test_trees_learn_steps_and_crossings():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = fit_trees(x[:3000], y[:3000])
    assert ((walk(model, x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_trees_without_a_choice():
    assert walk(fit_trees(np.zeros((0, 3)), np.zeros(0)), np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert walk(fit_trees(np.ones((9, 3)), np.ones(9)), np.zeros((1, 3)))[0] > 0.9
    same = fit_trees(np.ones((10, 2)), np.array([0.0, 1.0] * 5))
    assert walk(same, np.ones((1, 2)))[0] == pytest.approx(0.5)


def test_walk_is_the_same_as_one_row_at_a_time():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 4)), rng.integers(0, 2, 500).astype(float)
    model = fit_trees(x, y, trees=5)
    for row, score in zip(x[:50], walk(model, x[:50]), strict=True):
        margin = model["base"][0]
        for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"], strict=True):
            node = 0
            for _ in range(4):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += value[node]
        assert 1 / (1 + np.exp(-margin)) == pytest.approx(score)


def test_scores_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_odd_documents_and_labels(spark, documents_of):
    docs = documents_of([(1, None), (2, ""), (None, "some text"), (3, "word " * 50_000), (3, "again")])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert quality_scores(documents_of([]), labels.limit(0)).count() == 0
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert len(FEATURES) == len(set(FEATURES))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_base_counts(spark, documents_of):
    rng = random.Random(3)
    pieces = ["a", "bb", "é", "ñandú", "#x", "y$$", "<b>", "|", " ", "  ", "\n", "\t", "\x0b", " ", "a b c d e f ", "the line\n"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += [None, "", "\n\n", "one two three four five six seven eight nine ten", "same words here now ok " * 3000]
    rows = quality_rules(documents_of(list(enumerate(texts))), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(texts[r.doc_id]), texts[r.doc_id]
        assert r.score == 0 and r.kept == (not r.base_failed)
    assert len(rows) == len(texts)


def test_likelihood_ratio(spark):
    """Scores against counts by plain Python."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    bucket = lambda t: [((int.from_bytes(t[k : k + 4], "big") * 2654435761) & 0xFFFFFFFF) >> 16 for k in range(len(t) - 3)]
    raw, target = Counter(range(1 << 16)), Counter(range(1 << 16))
    for i, t in texts.items():
        raw.update(own := bucket(t))
        if i in good:
            target.update(own)
    ratio = np.array([np.log(target[k] / target.total()) - np.log(raw[k] / raw.total()) for k in range(1 << 16)])
    rows = quality_rules(docs, labels).collect()
    for r in rows:
        own = bucket(texts[r.doc_id])
        assert r.score == pytest.approx(ratio[own].mean() if own else 0.0, abs=1e-9)
    named = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in rows if r.kept}
    clean = [r.doc_id for r in rows if named.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(i in kept for i in clean) / len(clean) > 0.99
    junk = [i for i, q in named.items() if q == 0]
    assert sum(i not in kept for i in junk) / len(junk) > 0.9
    assert {r.doc_id for r in keep_good(docs, labels).collect()} == kept and keep_good(docs, labels).schema == docs.schema


def test_grams_stay_in_their_text():
    data = np.frombuffer(b"abcdefab", np.uint8)
    _, inside = grams(data, np.array([0, 6, 6, 8]))
    assert inside.tolist() == [True, True, True, False, False]


def test_rules_without_rows(spark, documents_of):
    labels = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    assert quality_rules(documents_of([]), labels).count() == 0


def plain_statistics(text):
    """The statistics of one text, word by word and byte by byte."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    lines = [x for x in data.split(b"\n")]
    worded = [x for x in lines if re.search(rb"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {k + i for k, w in enumerate(windows) if times[w] > 1 for i in range(5)}
    n, m, size = max(len(words), 1), len(words), max(len(data), 1)
    lower = [w.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for w in words]
    among = lambda marks: sum(b in marks for b in data) / size
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    chars = sum((b & 0xC0) != 0x80 for w in words for b in w)
    return {
        "log_bytes": math.log1p(len(data)), "log_words": math.log1p(m), "mean_word": mean, "std_word": math.sqrt(max(sum(x * x for x in lengths) / n - mean * mean, 0)),
        "upper": among(range(65, 91)), "digit": among(b"0123456789"), "non_ascii": among(range(128, 256)), "symbol": sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) / max(chars, 1),
        "bang": among(b"!"), "bar": among(b"|"), "stop_mark": among(b"."), "comma": among(b",;:"), "quote": among(b"\"'()[]{}="), "newline": among(b"\n"), "white": among(b" \t\n\x0b\x0c\r"),
        "dup_lines": (len(worded) - len(set(worded))) / len(lines), "repeat_words": len(repeated) / n, "distinct_words": len(set(lower)) / n,
        "same_as_last": sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n, "symbol_ends": sum(w[-1] in b"#*$%&|<>!" for w in words) / n,
        "capital_starts": sum(65 <= w[0] <= 90 for w in words) / n, "line_words": m / len(lines), "sentence_words": m / (1 + sum(b in b".!?" for b in data)), "long_words": sum(x > 12 for x in lengths) / n,
    }


def test_statistics_word_by_word():
    rng = random.Random(5)
    parts = ["The", "the", "THE", "end.", "é", "ñandú!", "#tag", "a|b", "12", "  ", "\n", "\n\n", "\t", "\x0b", "(x)", "supercalifragilistic", "a b c d e ", "wow!", "same same", "\x1c", "🙂"]
    texts = [None, "", " ", "\n", *["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]]
    got = statistics(*text_bytes(pa.array(texts, pa.string())))
    for row, text in zip(got, texts, strict=True):
        want = plain_statistics(text)
        assert dict(zip(FEATURES, row.tolist(), strict=True)) == pytest.approx({x: want[x] for x in FEATURES}, abs=1e-9), repr(text)


def test_first_split_is_the_best_one():
    """The root of the first tree against every feature and every cut between its values."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (90, len(FEATURES))).astype(float)
    y = ((x[:, 3] > 6) ^ (rng.random(90) < 0.1)).astype(float)
    model = fit_trees(x, y, trees=1, depth=1)
    p = y.mean()
    p = 1 / (1 + np.exp(-np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    grad, curve = p - y, np.full(len(y), p * (1 - p))

    def gain(left):
        part = lambda k: grad[k].sum() ** 2 / (curve[k].sum() + 1.0)
        return part(left) + part(~left) - part(np.ones(len(y), bool))

    every = {(f, cut): gain(x[:, f] <= cut) for f in range(len(FEATURES)) for cut in np.unique(x[:, f])[:-1]}
    found = (int(model["feature"][0, 0]), float(model["threshold"][0, 0]))
    chosen = gain(x[:, found[0]] <= found[1])
    assert chosen == pytest.approx(max(every.values())) and found[0] == 3
