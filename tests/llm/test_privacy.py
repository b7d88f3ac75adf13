"""Base rules against the plain patterns, the model against all segmentations, and what it adds."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from foliospark.llm.op10_privacy import KINDS, Model, Region, all_spans, base_spans, fit, learning_regions, luhn, private_spans, redact, redacted_text, regions, written

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and checks(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def checks(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def odd_text(rng):
    parts = ["a", "é", "@", ".", "..", "-", "+", "+1", "(", ") ", " ", "\n", "12", "255", "256", "0.0", "1.2.3.4", "x.y@z.com", "a@b", "4532015112830366", "4532 0151 1283 0366", "+1 (017) 555-7713", "007", "_%", "🙂"]
    return "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 25)))


@pytest.mark.parametrize("seed", range(4))
def test_base_rules(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        text = odd_text(rng)
        assert base_spans(text)[0] == plain_base(text), text


def test_check_digit():
    assert all(luhn(d) == checks(d) for d in (str(random.Random(k).randrange(10**15)) for k in range(300)))


def test_best_and_probable_segmentations():
    """Dynamic programming and forward-backward sums against every segmentation."""
    text = "call +1 (234) 567-8901 now"
    region = Region(text, 5, 22)
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 2, len(region.segments))
    ways = []
    for size in range(4):
        for some in itertools.combinations(range(len(scores)), size):
            used = [t for k in some for t in range(region.segments[k][0], region.segments[k][1] + 1)]
            if len(used) == len(set(used)):
                ways.append((sum(scores[k] for k in some), some))
        if size == 3:
            break
    model = Model({"x": 1.0})
    best = model.best(region, scores)
    assert max(w for w, some in ways) <= sum(scores[k] for k in best) + 1e-9
    small = Region("12345 678901", 0, 12)
    scores = rng.normal(0, 1, len(small.segments))
    ways = [some for size in range(3) for some in itertools.combinations(range(len(scores)), size) if len(used := [t for k in some for t in range(small.segments[k][0], small.segments[k][1] + 1)]) == len(set(used))]
    weights = np.array([np.exp(sum(scores[k] for k in some)) for some in ways])
    share = [sum(w for w, some in zip(weights, ways, strict=True) if k in some) / weights.sum() for k in range(len(scores))]
    assert model.posterior(small, scores) == pytest.approx(share)


@pytest.fixture(scope="module")
def model(spark):
    return fit(learning_regions(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 40_000, 2_000))


@pytest.mark.parametrize(
    "text, want",
    [
        ("Des +1 (826) 555-4081 190.137.223.204 du", ["+1 (826) 555-4081", "190.137.223.204"]),
        ("x 4532015112830366 4485275742308327 y", ["4532015112830366", "4485275742308327"]),
        ("call +1 (269) 555-3296 4532015112830366 and", ["+1 (269) 555-3296", "4532015112830366"]),
        ("token b44e15e09fd311c3cf3163b66d5a9875b883d8ce, version 2.0 of 1234567 words", []),
    ],
)
def test_neighbours_are_told_apart(model, text, want):
    assert [text[a:b] for a, b, _ in all_spans(text, model)[1]] == want


def test_added_spans_are_few_and_true(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in docs.select("text").collect():
        base, every = all_spans(r.text, model)
        for a, b, kind in set(every) - set(base):
            assert (kind == "card" and luhn(re.sub("[^0-9]", "", r.text[a:b]))) or re.fullmatch(PLAIN[kind], r.text[a:b])


def test_rows(documents_of):
    texts = [None, "", "no data", "mail a.b@c.org, 10.0.0.1", "x " * 60_000 + "4532015112830366", "1" * 30_000, "a" * 30_000 + "@" * 50, "é +1 (017) 555-7713"]
    rows = {r.doc_id: r for r in private_spans(documents_of([*enumerate(texts), (None, texts[3]), (3, texts[3])])).collect()}
    assert len(rows) == len(texts) + 1
    for k, text in enumerate(texts):
        base = plain_base(text or "") if len(text or "") < 10_000 or "453" in text else []
        assert [rows[k][f"n_{kind}"] for kind in KINDS] == [sum(s[2] == kind for s in base) for kind in KINDS]
        assert rows[k].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
    assert rows[7].spans == "phone:2:19" and rows[None].n_email == 1
    assert private_spans(documents_of([])).count() == 0


def test_redaction(documents_of):
    assert redacted_text("a 1.2.3.4 b", [(2, 9, "ip")]) == "a <IP> b"
    assert redacted_text("+12345678901234 z", [(0, 15, "phone"), (1, 15, "card")]) == "<PHONE> z"
    docs = documents_of([(1, "mail a.b@c.org now"), (2, None), (None, "plain")])
    out = redact(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.schema == docs.schema and rows[1].text == "mail <EMAIL> now" and rows[1].n_chars == 16 and rows[2].text is None and rows[None].text == "plain"


@pytest.mark.parametrize("unit", ["@", "a @ b ", "a@b.c ", "x.", "+1 ", "1 ", "a@b "])
def test_time_grows_with_the_length(unit):
    """Four times the text takes about four times as long."""
    import time

    def took(n):
        text = unit * (n // len(unit))
        began = time.process_time()
        base_spans(text)
        regions(text)
        return time.process_time() - began

    took(10_000)
    small = max(min(took(250_000) for _ in range(3)), 0.02)
    assert took(1_000_000) < 9 * small


def spoiled(rng):
    """Two neighbours of known kinds that may spoil each other's base match, and their places."""
    def card():
        digits = [rng.randint(1, 9)] + [rng.randint(0, 9) for _ in range(14)]
        last = next(d for d in range(10) if luhn("".join(map(str, digits)) + str(d)))
        text = "".join(map(str, [*digits, last]))
        return text, "card"

    def phone():
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}", "phone"

    def ip():
        return ".".join(str(rng.randint(1, 255)) for _ in range(4)), "ip"

    text, want = "Des mots ", []
    for make in rng.sample([card, phone, ip, card], 2):
        part, kind = make()
        want.append((len(text), len(text) + len(part), kind))
        text += part + " "
    return text + "du texte", want


def test_recall_of_spans_that_neighbours_spoil(model):
    """Of spans that no base rule finds, the model finds nine tenths and more of each kind."""
    rng = random.Random(8)
    hit, lost = Counter(), Counter()
    for _ in range(600):
        text, want = spoiled(rng)
        base, every = all_spans(text, model)
        for span in want:
            if span not in base:
                (hit if span in every else lost)[span[2]] += 1
    for kind in hit | lost:
        assert hit[kind] >= 0.9 * (hit[kind] + lost[kind]), (hit, lost)
