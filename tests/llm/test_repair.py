"""Repairs against the least of all edits, in one segment and in many."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

import foliospark.llm.op11_repair as op11
from foliospark.llm.op11_repair import SQL, damage, op11_repair, repair, repaired_turns, tables
from queries.compare import check, duck

SCHEMA = "conv_id long, turn long, role string, text string"
WORD, CLOSED = re.compile(r"[^\x20\x09-\x0D]"), ".!?"


def plain(turns):
    """Counts, cost, audit and repaired lines of the rows (turn, role, text) of one conversation."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in CLOSED else "")
        seen.add((role, text))

    def after(state, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    @cache
    def best(k, state, inserted):
        found = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        other = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[other]
        if inserted < 3:
            cost, audit, lines = best(k, other, inserted + 1)
            found.append((2 + cost, "I" + audit, (name + ":", *lines)))
        if k < len(rows):
            _, role, text = rows[k]
            cost, audit, lines = best(k + 1, state, 0)
            found.append((3 + cost, "D" + audit, lines))
            if faults[k] not in ("blank", "duplicate"):
                more = faults[k] == "truncated"
                cost, audit, lines = best(k + 1, other, 0)
                found.append((2 + more + cost, "R" + audit, (f"{name}:{text}", *lines)))
                if (to := after(state, role[:1])) is not None:
                    cost, audit, lines = best(k + 1, to, 0)
                    found.append((more + cost, "K" + audit, (f"{role}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), list(lines)


def conversation(rng):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage", "Über"]
    texts = ["Yes.", "No", "Why?", " \n", "", None, "Well.\t", "so \x0b", "done!\x85", "…", "é."]
    return [(rng.choice([None, *range(4)]) if rng.random() < 0.3 else k, rng.choice(roles[: rng.choice([3, 10])]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randint(0, 99)}" + rng.choice([".", ""])) for k in range(rng.randint(1, 14))]


@pytest.fixture(scope="module")
def many():
    rng = random.Random(5)
    return {k: conversation(rng) for k in range(250)} | {None: conversation(rng), 900: [(3, "user", "a.")] * 9, 901: [(1, "assistant", " ")], 902: [(k, "user", f"{k}.") for k in range(60)]}


def rows_of(many):
    rows = [(c, *t) for c, turns in many.items() for t in turns]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [4096, 3])
def test_repair(spark, monkeypatch, many, size):
    monkeypatch.setattr(op11, "TURNS", size)
    df = spark.createDataFrame(rows_of(many), SCHEMA).selectExpr("*", "1 AS conv", "'x' AS k", "2 AS part", "'y' AS state", "true AS first")
    got = {r.conv_id: tuple(r)[1:] for r in repair(df).collect()}
    assert got == {c: plain(t)[:-1] for c, t in many.items()}


def test_repaired_turns(spark, many):
    got = {}
    for r in sorted(repaired_turns(spark.createDataFrame(rows_of(many), SCHEMA)).collect(), key=lambda r: (r.part, r.k, r.place)):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got == {c: plain(t)[-1] for c, t in many.items() if plain(t)[-1]}


def test_damage(spark, many):
    rows = rows_of(many)
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want += [(c, t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = [tuple(r) for r in damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_query(spark, tmp_path, many):
    assert check(spark, duck("/root/testdata/sf0.001"), "/root/testdata/sf0.001", op11_repair, SQL) == ""
    spark.createDataFrame(rows_of(many), SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(SQL).fetchall()
    names = con.sql(SQL).columns
    got = op11_repair(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty).count() == 0 and repaired_turns(empty).count() == 0
    empty.write.parquet(str(tmp_path / "conversations.parquet"))
    assert op11_repair(spark, str(tmp_path)).count() == 0


def test_blocks():
    """Block moves are those of their symbols, and the vectors are few."""
    table = tables()
    assert len(table.vectors) < 100
    rng = random.Random(3)
    for _ in range(300):
        symbols = bytes(rng.randint(1, 9) for _ in range(rng.randint(0, 23)))
        v = 0
        for x in reversed(symbols):
            v = table.move[v][x]
        assert table.lookups(symbols, 0)[-1] == v
