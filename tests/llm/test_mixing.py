"""Targets against repeated resharing, and what the rounding promises."""

import random
import re

import pytest

from foliospark.llm.op1_mixing import mix, mixing_plan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Water is shared by weight; what is over a source's cap is shared again among the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, live, left = {}, set(names), share * sum(sizes.values())
    while live:
        total = sum(weight[s] for s in live)
        over = {s for s in live if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in live}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        live -= over
    return out


def sample(n=600, seed=1):
    rng = random.Random(seed)
    rows = [(k, " ".join("w" * rng.randint(1, 4) for _ in range(int(rng.paretovariate(0.9)) % 300)), "en", rng.choice(["a", "a", "a", "a", "b", "é", "z", None])) for k in range(n)]
    return rows + [(n, None, "en", "a"), (n + 1, "", "en", "only empty"), (None, "some words here", "en", "a"), (None, "some words here", "en", "a"), (7, rows[7][1], "en", rows[7][3])]


def test_targets_and_rounding(documents_of):
    rows = sample()
    sizes, most = {}, {}
    for _, text, _, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source], most[source] = sizes.get(source, 0) + n, max(most.get(source, 0), n)
    wanted = targets(sizes)
    plan = mixing_plan(documents_of(rows), fan_in=8).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in plan) == sorted((i is None, i or 0, len(WORD.findall(t or ""))) for i, t, _, _ in rows)
    taken, name_of = {}, {(i, len(WORD.findall(t or ""))): s for i, t, _, s in rows}
    for r in plan:
        source = name_of[r.doc_id, r.size]
        assert r.source_size == sizes[source] and r.target == pytest.approx(wanted[source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        rate = wanted[source] / sizes[source] if r.size else 0
        assert int(rate + 1e-9) <= r.copies <= int(rate + 1e-9) + 1
        taken[source] = taken.get(source, 0) + r.taken
    for source, total in taken.items():
        assert abs(total - wanted[source]) <= most[source]


def test_reruns_and_partitions_agree(documents_of):
    first, second = (sorted((str(r.doc_id), r.size, r.taken) for r in mixing_plan(documents_of(sample(), parts), fan_in=8).collect()) for parts in (1, 5))
    assert first == second


def test_mix_holds_each_document_as_often_as_taken(documents_of):
    docs = documents_of(sample(200))
    out = mix(docs, fan_in=8)
    assert out.columns == [c for c in docs.columns if c != "mix_copy"] + ["mix_copy"]
    rows = out.collect()
    assert len(rows) == len({(r.doc_id, r.text, r.source, r.mix_copy) for r in rows}) and max(r.mix_copy for r in rows) <= 4
    assert {r.row for r in rows} == {"r"}


def test_expectations(documents_of):
    rows = [(k, "a b c d e"[: 2 * (1 + k % 5) - 1], "en", "s" if k % 2 else "t") for k in range(4000)]
    plan = mixing_plan(documents_of(rows)).collect()
    small = [r for r in plan if r.size == 2 and r.copies is not None and r.doc_id % 2]
    assert sum(r.copies for r in small) / len(small) == pytest.approx(small[0].target / small[0].source_size, abs=0.1)


def test_empty(documents_of):
    docs = documents_of([])
    assert mixing_plan(docs).count() == 0 and mix(docs).count() == 0
    assert [(r.taken, r.target) for r in mixing_plan(documents_of([(1, None), (2, " ")])).collect()] == [(0, 0.0)] * 2
