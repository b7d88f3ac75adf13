"""Repair of conversations to alternating turns at least cost, by Four-Russians block tables.

A conversation's turns are to be a system turn or none, and then pairs of a user and an assistant turn (or no turn at
all). Turns are kept (0), given another role (2), deleted (3), or turns without text are inserted (2); a turn that is
left but breaks off costs 1 more, and turns without a word or that repeat an earlier one (role and text) must go.
Roles count by their first character.

What it costs to end well from each of the four states (nothing yet, after system, after user, after assistant), less
the least of the four, can be one of a few vectors only. A turn is one of nine symbols (which role, broken off or not,
must go) and moves one vector to another; a table has those moves for every vector and every block of ``BLOCK``
symbols. A conversation is read from its end, a block per lookup. Then it is traced from its start: each block is
expanded from the vector at its end backward, and of all cheapest edits the one whose letters (D, I, K, R) come first
is taken, which leaves the least string among all cheapest ones.

Equal rows are counted before anything else, the first of equal texts is found by a grouping, and rows are dealt by
ranges of (conversation, turn, role, text), so a conversation of any size lies over many tasks, in segments of up to
``TURNS`` turns. One byte a turn goes to the task that finds the vector and the state at each segment's ends (some 30 bytes a
segment are held at a time); segments are then traced apart. Only the digest of a conversation of several segments
needs its repaired text in order: it streams through one task, a segment at a time.

Rows of a null conv_id are one conversation; a null turn comes first; a null role or text is one space. Rows of one turn
go by role, then text. Equal rows stay as repeated turns. An empty table has no conversations; extra columns change
nothing.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import Scratch

BLOCK = 4
TURNS, BYTES = 4096, 200_000
#: Segments that a task works on at a time.
SOME = 50
NONE, GONE = 0, 1
ROLES = "sua"  # first characters; any other is a fourth kind
START, SYSTEM, USER, ASSISTANT = range(4)
SYMBOLS = 10  # none, gone, and four kinds of roles, whole or broken off
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
GIVEN = (USER, USER, ASSISTANT, USER)  # the state after a turn that is inserted or whose role is changed
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEYS = ["has_conv", "conv", "has_turn", "at", "role"]
CONV = KEYS[:2]
SEGMENT = (
    "has_conv boolean, conv long, part int, k int, symbols binary, roles array<string>, texts array<string>, blank long, duplicate long, "
    "truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"
)
LINE = "array<struct<edit:string,role:string,text:string>>"
TOLD = "has_conv boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from each state before a symbol, from those after it."""
    if symbol == NONE:
        return after
    kind, broken = divmod(symbol - 2, 2)
    own = []
    for q in range(4):
        cost = [3 + after[q]]
        if symbol != GONE:
            cost.append(2 + broken + after[GIVEN[q]])
            if (q, kind) in KEPT:
                cost.append(broken + after[KEPT[q, kind]])
        own.append(min(cost))
    user, assistant = min(own[USER], 2 + own[ASSISTANT]), min(own[ASSISTANT], 2 + own[USER])
    return min(own[START], 2 + user), min(own[SYSTEM], 2 + user), user, assistant


def edits(symbol: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The first letters among the cheapest edits up to and with a symbol, and the state after it."""
    now = before(symbol, after)
    kind, broken = divmod(symbol - 2, 2)
    letters = ""
    while True:
        if now[state] == 3 + after[state]:
            return letters + "D", state
        if now[state] == 2 + now[GIVEN[state]]:
            letters, state = letters + "I", GIVEN[state]
        elif symbol != GONE and (state, kind) in KEPT and now[state] == broken + after[KEPT[state, kind]]:
            return letters + "K", KEPT[state, kind]
        else:
            return letters + "R", GIVEN[state]


class Tables:
    """All vectors, their moves by one symbol and by a block, and the edits of each state, symbol and vector."""

    def __init__(self) -> None:
        end = (0, 4, 2, 0)
        number, vectors, k = {end: 0}, [end], 0
        self.move, self.cost = [], []
        while k < len(vectors):
            moves = [before(x, vectors[k]) for x in range(SYMBOLS)]
            least = [min(m) for m in moves]
            small = [tuple(c - a for c in m) for m, a in zip(moves, least, strict=True)]
            for m in small:
                if m not in number:
                    number[m] = len(vectors)
                    vectors.append(m)
            self.move.append([number[m] for m in small])
            self.cost.append(least)
            k += 1
        self.vectors = vectors
        self.blocks, self.codes = [], {x: k for k, x in enumerate(itertools.product(range(SYMBOLS), repeat=BLOCK))}
        for v in range(len(vectors)):
            row = bytearray()
            for block in self.codes:
                to = v
                for x in reversed(block):
                    to = self.move[to][x]
                row.append(to)
            self.blocks.append(bytes(row))
        self.steps = [[[edits(x, q, v) if x != NONE else ("", q) for v in vectors] for x in range(SYMBOLS)] for q in range(4)]

    def lookups(self, symbols: bytes, right: int) -> list[int]:
        """The vector at the end of each block, and at last the one at the start, from the right; the last block is filled up."""
        whole = symbols + bytes(-len(symbols) % BLOCK)
        at = [right]
        for k in range(len(whole) - BLOCK, -1, -BLOCK):
            at.append(self.blocks[at[-1]][self.codes[tuple(whole[k : k + BLOCK])]])
        return at

    def traced(self, symbols: bytes, ends: list[int], state: int) -> tuple[list[str], int]:
        """The edits up to and with each symbol, and the state after the last; ``ends`` are the lookups."""
        out = []
        for k, right in zip(range(0, len(symbols), BLOCK), reversed(ends[:-1]), strict=True):
            block = symbols[k : k + BLOCK]
            inside = [right]
            for x in reversed(block[1:]):
                inside.append(self.move[inside[-1]][x])
            for x, v in zip(block, reversed(inside), strict=True):
                letters, state = self.steps[state][x][v]
                out.append(letters)
        return out, state


@cache
def tables() -> Tables:
    return Tables()


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by a checksum of conversation and turn: 0 drops a row, 1 takes its text,
    2 its closing marks, 3 repeats it, 4 makes it a user's (of 20). Nulls are one space there."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key) % 20
    text = F.coalesce("text", space)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("times"),
        fault.alias("fault"),
    )
    return rows.filter("fault <> 0").select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def segments(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The turns in order, as symbols and texts, cut into segments that are numbered by (part, k)."""
    space = F.lit(" ")
    has = lambda c: F.col(c).isNotNull()
    rows = turns.select(
        has("conv_id").alias("has_conv"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        has("turn").alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    counted = rows.groupBy(*KEYS, F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("times"))
    firsts = counted.groupBy(*CONV, "role", "digest").agg(F.min(F.struct("has_turn", "at")).alias("m")).select(*CONV, "m.*", "role", "digest", F.lit(True).alias("first"))
    blank, broken = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z")
    found = counted.join(firsts, [*KEYS, "digest"], "left").withColumns({"first": F.coalesce("first", F.lit(False)), "blank": blank, "broken": broken})
    found = scratch.store(found.drop("digest"))
    order = [*KEYS, "text"]
    cut = scratch.store(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, SEGMENT))
    scratch.drop(found)
    return cut


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


SEGMENT_ARROW = pa.schema(
    [("has_conv", pa.bool_()), ("conv", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("symbols", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    + [(x, pa.string() if "initial" in x else pa.int64()) for x in _names(SEGMENT)[7:]]
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of sorted rows; no segment goes over two conversations."""
    part, k = TaskContext.get().partitionId(), 0
    now: dict | None = None
    size = held = 0
    done: list[dict] = []

    def told() -> pa.RecordBatch:
        rows = [x | {"symbols": bytes(x["symbols"])} for x in done]
        done.clear()
        return pa.RecordBatch.from_pylist(rows, SEGMENT_ARROW)

    for batch in batches:
        for row in batch.to_pylist():
            initial, turn = row["role"][:1], row["at"] if row["has_turn"] else None
            kind = ROLES.find(initial) if initial else -1
            symbol = 2 + 2 * (kind if kind >= 0 else 3) + row["broken"]
            for n in range(row["times"]):
                if now is None or (now["has_conv"], now["conv"]) != (row["has_conv"], row["conv"]) or len(now["symbols"]) >= TURNS or size >= BYTES:
                    if now is not None:
                        done.append(now)
                        held += size
                        if len(done) >= 20 * SOME or held >= 20 * BYTES:
                            yield told()
                            held = 0
                    now = {"has_conv": row["has_conv"], "conv": row["conv"], "part": part, "k": k, "symbols": bytearray(), "roles": [], "texts": []}
                    now |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"first_initial": initial, "first_turn": turn, "last_turn": None}
                    k, size = k + 1, 0
                elif now["last_initial"] + initial not in ("su", "ua", "au"):
                    now["illegal"] += 1
                fault = "blank" if row["blank"] else "duplicate" if n or not row["first"] else "truncated" if row["broken"] else None
                if fault:
                    now[fault] += 1
                gone = fault in ("blank", "duplicate")
                now["symbols"].append(GONE if gone else symbol)
                now["roles"].append(row["role"])
                now["texts"].append(None if gone else row["text"])
                size += 0 if gone else len(row["text"])
                if turn is not None:
                    if now["first_turn"] is None:
                        now["first_turn"] = turn
                    now["turns"] += turn != now["last_turn"]
                    now["last_turn"] = turn
                now["last_initial"] = initial
    if now is not None:
        done.append(now)
        yield told()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the segments of each conversation, from the last to the first: the vector at its end and the state at its start."""
    table = tables()
    conv, held = None, []

    def told() -> Iterator[pa.RecordBatch]:
        state = START
        while held:
            some = []
            while held and len(some) < 50_000:
                part, k, right, exits = held.pop()
                some.append((*conv, part, k, right, state, not held))
                state = exits[state]
            columns = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), *[pa.int32()] * 4, pa.bool_()), strict=True)], ENDS_NAMES)

    for batch in batches:
        for row in batch.to_pylist():
            if (row["has_conv"], row["conv"]) != conv:
                yield from told()
                conv, right = (row["has_conv"], row["conv"]), 0
            ends = table.lookups(row["symbols"], right)
            held.append((row["part"], row["k"], right, bytes(table.traced(row["symbols"], ends, q)[1] for q in range(4))))
            right = ends[-1]
    yield from told()


ENDS = "has_conv boolean, conv long, part int, k int, right int, state int, last boolean"
ENDS_NAMES = _names(ENDS)


def _lines(row: dict) -> tuple[str, int, list[dict]]:
    """Letters, cost and lines (deleted ones left out) of one segment."""
    table = tables()
    symbols, state = row["symbols"], row["state"]
    steps, _ = table.traced(symbols, table.lookups(symbols, row["right"]), state)
    lines, cost = [], 0
    for symbol, letters, role, text in zip(symbols, steps, row["roles"], row["texts"], strict=True):
        for letter in letters[:-1]:
            state = GIVEN[state]
            lines.append({"edit": letter, "role": NAMES[state], "text": ""})
        edit = letters[-1]
        if edit == "R":
            state = GIVEN[state]
            role = NAMES[state]
        elif edit == "K":
            state = KEPT[state, (symbol - 2) // 2]
        if edit != "D":
            lines.append({"edit": edit, "role": role, "text": text})
        cost += 2 * (len(letters) - 1) + {"D": 3, "R": 2 + symbol % 2, "K": symbol % 2}[edit]
    audit = "".join(steps)
    while row["last"] and state in (SYSTEM, USER):
        state, audit, cost = GIVEN[state], audit + "I", cost + 2
        lines.append({"edit": "I", "role": NAMES[state], "text": ""})
    return audit, cost, lines


TRACED = TOLD + ", part int, k int, last boolean, first_initial string, last_initial string, first_turn long, last_turn long, turns long, body binary"
TRACED_ARROW = pa.schema([(n, {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in TRACED.split(", "))])


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their edits; a conversation of one segment is done, of others the repaired text goes on."""
    keep = [*CONV, "part", "k", "last", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "turns"]
    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            out = []
            for row in batch.slice(at, SOME).to_pylist():
                audit, cost, lines = _lines(row)
                body = "\n".join(f"{x['role']}:{x['text']}" for x in lines).encode()
                one = {k: row[k] for k in keep} | {"audit": audit, "cost": cost}
                if row["last"] and row["alone"]:
                    one |= {"repaired_sha256": hashlib.sha256(body).hexdigest(), "gaps": _gaps(row["first_turn"], row["last_turn"], row["turns"])}
                else:
                    one["body"] = body if lines else None
                out.append(one)
            yield pa.RecordBatch.from_pylist(out, TRACED_ARROW)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of several segments, whose segments come in order."""
    names = _names(TOLD)
    schema = pa.schema([TRACED_ARROW.field(n) for n in names])
    now, digest, audit, begun = None, None, [], False
    for batch in batches:
        for row in batch.to_pylist():
            if now is None:
                now, digest, audit, begun = row, hashlib.sha256(), [], False
            else:
                for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    now[k] += row[k]
                now["illegal"] += now["last_initial"] + row["first_initial"] not in ("su", "ua", "au")
                now["turns"] += row["turns"] - (row["turns"] > 0 and row["first_turn"] == now["last_turn"])
                now["last_initial"] = row["last_initial"]
                if row["turns"]:
                    now["first_turn"] = row["first_turn"] if now["first_turn"] is None else now["first_turn"]
                    now["last_turn"] = row["last_turn"]
            audit.append(row["audit"])
            if row["body"] is not None:
                digest.update(b"\n" * begun + row["body"])
                begun = True
            if row["last"]:
                done = now | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest(), "gaps": _gaps(now["first_turn"], now["last_turn"], now["turns"])}
                yield pa.RecordBatch.from_pylist([{n: done[n] for n in names}], schema)
                now = None


def _planned(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Segments with the vector at their end, the state at their start, and whether they are their conversation's last or only one."""
    cut = segments(turns, scratch)
    order = [F.col(c) for c in CONV] + [F.desc("part"), F.desc("k")]
    ends = cut.select(*CONV, "part", "k", "symbols").repartition(*CONV).sortWithinPartitions(*order).mapInArrow(_ends, ENDS)
    # the first segment of a conversation has the start state, and no other one can be alone
    count = cut.groupBy(*CONV).agg((F.count("*") == 1).alias("alone"))
    ends = scratch.store(ends.join(count, CONV))
    return cut.join(ends, [*CONV, "part", "k"])


def conv_id() -> Column:
    return F.when(F.col("has_conv"), F.col("conv")).alias("conv_id")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, part, k and place (their order), edit (I, K or R), role, text."""
    out = _planned(turns, Scratch(turns.sparkSession, "op11"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, SOME):
                rows = batch.slice(at, SOME)
                lines = pa.array([_lines(row)[2] for row in rows.to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (*CONV, "part", "k")), lines], [*CONV, "part", "k", "lines"])

    lines = out.mapInArrow(run, f"has_conv boolean, conv long, part int, k int, lines {LINE}")
    return lines.select(conv_id(), "part", "k", F.posexplode("lines").alias("place", "line")).select("conv_id", "part", "k", "place", "line.*")


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: counts of its faults, the cost and letters of the cheapest edits, a digest of the result."""
    scratch = Scratch(turns.sparkSession, "op11")
    traced = scratch.store(_planned(turns, scratch).mapInArrow(_traced, TRACED))
    names = _names(TOLD)
    one = traced.filter("repaired_sha256 is not null").select(*names)
    order = [*CONV, "part", "k"]
    several = traced.filter("repaired_sha256 is null").repartition(*CONV).sortWithinPartitions(*order).mapInArrow(_joined, TOLD)
    return one.unionByName(several).select(conv_id(), *names[2:])


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "its_conv")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("its_conv")), "left").drop("its_conv")
    return joined.fillna({c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


def cheapest(kept: str, given: str, least: str) -> str:
    """SQL of the costs before a turn, from those (e, s, u, a) after it."""
    return f"least(3 + {least}, CASE WHEN NOT gone THEN {given} END, CASE {kept} END)"


SQL = f"""
WITH RECURSIVE bytes_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) AS t
),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
checked AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + length(key)), lambda i: ascii(key[i])::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS fault
  FROM keyed, bytes_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM checked WHERE fault <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faulty AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*$') AS broken, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM placed
),
rows_ AS (SELECT conv_id, i, role, text, role[1] AS initial, blank OR again AS gone, CASE WHEN broken THEN 1 ELSE 0 END AS cut FROM faulty),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (broken AND NOT again AND NOT blank) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
costs AS (
  SELECT conv_id, n AS i, 0 AS e, 4 AS s, 2 AS u, 0 AS a FROM counts
  UNION ALL
  SELECT conv_id, i - 1, least(be, 2 + bu, 4 + ba), least(bs, 2 + bu, 4 + ba), least(bu, 2 + ba), least(ba, 2 + bu) FROM (
    SELECT c.conv_id, c.i,
           {cheapest("WHEN NOT gone AND initial = 's' THEN cut + s WHEN NOT gone AND initial = 'u' THEN cut + u", "2 + cut + u", "e")} AS be,
           {cheapest("WHEN NOT gone AND initial = 'u' THEN cut + u", "2 + cut + u", "s")} AS bs,
           {cheapest("WHEN NOT gone AND initial = 'a' THEN cut + a", "2 + cut + a", "u")} AS bu,
           {cheapest("WHEN NOT gone AND initial = 'u' THEN cut + u", "2 + cut + u", "a")} AS ba
    FROM costs c JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i
  )
),
vectors AS (SELECT conv_id, i, MAP {{'e': e, 's': s, 'u': u, 'a': a}} AS g FROM costs),
steps AS (
  SELECT r.*, v.g AS now, w.g AS after FROM rows_ r JOIN vectors v ON v.conv_id IS NOT DISTINCT FROM r.conv_id AND v.i = r.i - 1
  JOIN vectors w ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = r.i
  UNION ALL
  SELECT conv_id, n + 1, NULL, NULL, NULL, false, 0, NULL, NULL FROM counts
),
traced AS (
  SELECT conv_id, 1::BIGINT AS i, 'e' AS q, '' AS audit, []::VARCHAR[] AS lines, false AS done FROM counts
  UNION ALL
  SELECT conv_id, CASE WHEN letter IN ('I', '.') THEN i ELSE i + 1 END,
         CASE letter WHEN 'D' THEN q WHEN '.' THEN q WHEN 'K' THEN initial ELSE next END,
         CASE letter WHEN '.' THEN audit ELSE audit || letter END,
         CASE letter WHEN 'D' THEN lines WHEN '.' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
              ELSE list_append(lines, CASE next WHEN 'u' THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN text ELSE '' END) END,
         letter = '.'
  FROM (
    SELECT t.conv_id, t.i, t.q, t.audit, t.lines, s.role, s.text, s.initial, CASE WHEN t.q = 'u' THEN 'a' ELSE 'u' END AS next,
           CASE WHEN s.now IS NULL THEN CASE WHEN t.q IN ('u', 's') THEN 'I' ELSE '.' END
                WHEN s.now[t.q] = 3 + s.after[t.q] THEN 'D'
                WHEN s.now[t.q] = 2 + s.now[CASE WHEN t.q = 'u' THEN 'a' ELSE 'u' END] THEN 'I'
                WHEN NOT s.gone AND ((t.q = 'e' AND s.initial IN ('s', 'u')) OR (t.q IN ('s', 'a') AND s.initial = 'u') OR (t.q = 'u' AND s.initial = 'a'))
                     AND s.now[t.q] = s.cut + s.after[s.initial] THEN 'K'
                ELSE 'R' END AS letter
    FROM traced t JOIN steps s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.i = t.i WHERE NOT t.done
  )
),
done AS (SELECT t.conv_id, c.e AS cost, t.audit, sha256(array_to_string(t.lines, chr(10))) AS repaired FROM traced t JOIN costs c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.i = 0 WHERE t.done)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(d.cost, 0)::BIGINT AS cost, coalesce(d.audit, '') AS audit, coalesce(d.repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
