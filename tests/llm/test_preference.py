"""Preference formatting against plain Python, and its SQL."""

import random

import __spark_entry__ as entry
from foliospark.llm.op6_preference import assemble, preference_turns
from queries.compare import check, duck

SCHEMA = "pair_id long, side string, turn long, role string, text string"


def plain(rows):
    """part, turn, seq, rendered, trained of each pair, by walking both sides together."""
    out, pairs = [], {}
    for pair, side, turn, role, text in set(rows):
        if side in ("chosen", "rejected"):
            pairs.setdefault(pair, {"chosen": [], "rejected": []})[side].append((turn, role, text))
    none_first = lambda x: (x is not None, x if x is not None else 0)
    for pair, sides in pairs.items():
        placed = {}
        for side, turns in sides.items():
            turns.sort(key=lambda t: (none_first(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
            seq, own = {}, []
            for t in turns:
                seq[t[0]] = seq.get(t[0], -1) + 1
                own.append((t[0], seq[t[0]], t[1], t[2]))
            placed[side] = own
        same = 0
        for a, b in zip(placed["chosen"], placed["rejected"], strict=False):
            if a != b:
                break
            same += 1
        for side, own in placed.items():
            for k, (turn, seq, role, text) in enumerate(own):
                if k >= same or side == "chosen":
                    part = "prompt" if k < same else side
                    out.append((pair, part, turn, seq, f"<|im_start|>{role if role is not None else 'user'}\n{text or ''}<|im_end|>\n", part != "prompt" and role == "assistant"))
    return out


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for pair in [*range(60), None]:
        turns = [(t, rng.choice(["user", "assistant", "system", None]), rng.choice(["x", "y", "", None, "long " * 2000])) for t in [None, 0, 1, 2, 2, 3][: rng.randint(0, 6)]]
        cut = rng.randint(0, len(turns))
        other = turns[:cut] + [(t, r, x if rng.random() < 0.5 else "changed") for t, r, x in turns[cut:]][: rng.randint(0, 6)]
        rows += [(pair, "chosen", *t) for t in turns] + [(pair, "rejected", *t) for t in other]
    return rows + rows[:30] + [(3, None, 0, "user", "no side"), (4, "other", 0, "user", "no side")]


def key(row):
    return tuple(str(x) for x in row)


def test_against_a_walk(spark):
    for seed in range(3):
        rows = sample(seed)
        turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS seq", "'p' AS part", "2 AS split", "3 AS its_pair")
        got = preference_turns(turns).select("pair_id", "part", "turn", "seq", "rendered", "trained").collect()
        assert sorted(map(key, got)) == sorted(map(key, plain(rows)))


def test_one_long_conversation_and_assembly(spark):
    turns = [(t, "assistant" if t % 2 else "user", f"t{t}") for t in range(3000)]
    rows = [(1, "chosen", *t) for t in turns] + [(1, "rejected", *t) for t in turns[:2990]] + [(2, "chosen", 0, "user", "alone")]
    out = preference_turns(spark.createDataFrame(rows, SCHEMA))
    counts = {(r.pair_id, r.part): r["count"] for r in out.groupBy("pair_id", "part").count().collect()}
    assert counts == {(1, "prompt"): 2990, (1, "chosen"): 10, (2, "chosen"): 1}
    whole = {r.pair_id: r for r in assemble(out).collect()}
    assert whole[1].chosen.startswith("<|im_start|>user\nt2990<|im_end|>\n<|im_start|>assistant\nt2991") and whole[1].rejected == ""
    assert whole[2].prompt == "" and "alone" in whole[2].chosen


def test_empty(spark):
    assert preference_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert check(spark, duck(sf), sf, entry.queries()["op6_preference"], entry.oracle_sql()["op6_preference"]) == ""
