"""Components against an inverted list of all shingles, bounds against true overlaps."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import op7_jaccard
from foliospark.llm.components import components
from foliospark.llm.op7_jaccard import Tree, document_sets, jaccard_components, keep_one, point
from foliospark.llm.shared import Scratch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_set(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset()


def linked(a, b):
    common = len(a & b)
    return bool(a) and bool(b) and 100 * common >= 80 * (len(a) + len(b) - common)


def brute(rows):
    """doc_id -> (set size, component)."""
    sets = {i: plain_set(t) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in ids:
        for shingle in sets[i]:
            holders[shingle].append(i)
    for i in ids:
        for j in Counter(j for s in sets[i] for j in holders[s] if j < i):
            if linked(sets[i], sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    fresh = lambda k: [rng.choice(words) for _ in range(k)]
    base = [fresh(rng.choice([3, 5, 12, 60, 150])) for _ in range(12)]
    passage = fresh(40)
    out = []
    for _ in range(n):
        text = list(rng.choice(base)) if rng.random() < 0.6 else fresh(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.2:
            text += passage
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_components(documents_of, small_batches, seed):
    texts = near_copies(seed) + [None, "", " \n", "one", "ONE", "one two three four", "One two\tthree four", "word " * 30_000]
    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents_of(rows)).collect()}
    assert got == brute(rows)


def test_crowd_that_only_its_original_joins(documents_of):
    """Copies of one text that are too far from each other: links to the original only, in cells of over 32 sets."""
    rng = random.Random(9)
    original = [f"o{k}" for k in range(200)]
    rows = [(500, " ".join(original))]
    for k in range(70):
        copy = list(original)
        for at in rng.sample(range(5, 195), 4):
            copy[at] = f"x{k}_{at}"
        rows.append((k, " ".join(copy)))
    rows += [(300 + k, " ".join(original[:150] + [f"y{k}_{j}" for j in range(60)])) for k in range(40)]
    want = brute(rows)
    sets = {i: plain_set(t) for i, t in rows}
    assert sum(linked(sets[a], sets[b]) for a in range(70) for b in range(a)) < 70 * 69 / 4
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents_of(rows)).collect()}
    assert got == want and len({c for _, c in want.values()}) > 2


def test_no_task_holds_a_whole_crowd(documents_of, small_batches, monkeypatch):
    """A crowd with far copies in its cells: blocks of few points, several tasks for the sets that ask in one."""
    rng = random.Random(3)
    original = [f"o{k}" for k in range(200)]
    rows = []
    for k in range(160):
        copy = list(original)
        for at in rng.sample(range(5, 195), 4 if k < 90 else 9):
            copy[at] = f"x{k}_{at}"
        rows.append((k, " ".join(copy)))
    rows += [(300 + k, " ".join(original[:150] + [f"y{k}_{j}" for j in range(60)])) for k in range(40)]
    monkeypatch.setattr(op7_jaccard, "BLOCK", 20_000)
    monkeypatch.setattr(op7_jaccard, "QUERIES", 10)
    rounds, plain = [], op7_jaccard.crowd_rows

    def spied(*args):
        out = plain(*args)
        rounds.append(out.groupBy("block", "slice", "asks").agg(F.count("*").alias("k"), F.sum(F.length("point") + 8 * F.size("cells")).alias("held")).collect())
        return out

    monkeypatch.setattr(op7_jaccard, "crowd_rows", spied)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents_of(rows)).collect()}
    assert got == brute(rows)
    assert rounds and len({r.block for r in rounds[0]}) > 2 and max(r.slice for r in rounds[0]) > 0
    assert all(r.held < 50_000 for x in rounds for r in x if not r.asks) and all(r.k < 30 for x in rounds for r in x if r.asks)


def test_tree_search_misses_nothing():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 62, k, dtype=np.uint64)) for k in (30, 90, 100, 300)]
    sets = []
    for _ in range(120):
        own = base[rng.integers(4)]
        own = own[rng.random(len(own)) > rng.random() * 0.25]
        sets.append(np.unique(np.append(own, rng.integers(0, 1 << 62, rng.integers(0, 20), dtype=np.uint64))))
    tree = Tree([np.frombuffer(point(s), np.uint8) for s in sets], np.array([len(s) for s in sets]))
    for q in range(len(sets)):
        found = set(tree.order[tree.search(q)].tolist())
        own = sets[tree.order[q]]
        for k, other in enumerate(sets):
            common = len(np.intersect1d(own, other))
            if k != tree.order[q] and 100 * common >= 80 * (len(own) + len(other) - common):
                assert k in found


def test_sets_hold_whole_texts():
    import pyarrow as pa

    sets = document_sets(pa.array(["a b c d e f", None, "A b C d e f", "a", "x y", "e f"]))
    assert [len(s) for s in sets] == [2, 0, 2, 1, 1, 1] and sets[0].tolist() == sets[2].tolist()


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links, Scratch(spark, "test")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 180)}


def test_repeated_rows_null_ids_and_empty_tables(documents_of):
    text = "a text of some words that stands here more than once"
    rows = [(3, text), (3, text), (5, text), (None, text), (None, None), (8, "alone")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(documents_of(rows)).collect())
    assert got == sorted([("3", 7, "3"), ("3", 7, "3"), ("5", 7, "3"), ("None", 7, "None"), ("None", 0, "None"), ("8", 1, "8")])
    docs = documents_of(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "8", "None", "None"]
    assert jaccard_components(documents_of([])).count() == 0 and keep_one(documents_of([])).count() == 0


def test_rows_of_one_id_are_kept_or_dropped_one_by_one(documents_of):
    words = [f"w{k}" for k in range(120)]
    near = words[:60] + ["other"] + words[61:]
    a, copy = " ".join(words), " ".join(near)
    rows = [(1, a), (3, a), (3, "a text that nothing else holds at all"), (4, copy), (4, "one more text that is alone in here"), (6, copy), (6, copy.upper()), (7, "the third text of its own"), (7, "The third text of its own")]
    got = sorted((r.doc_id, r.text.lower()) for r in keep_one(documents_of(rows)).collect())
    assert got == [(1, a), (3, rows[2][1]), (4, rows[4][1]), (7, rows[7][1])]


def test_rows_of_one_id_in_both_engines(spark, documents_of, tmp_path):
    """Rows of one doc_id with several texts, and rows without one, are judged row by row in the SQL too."""
    import duckdb

    texts = near_copies(9, 90) + [None, "", "one two"]
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30)]), t) for t in texts] + [(3, texts[0]), (3, texts[0]), (31, texts[0])]
    docs = documents_of(rows)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    got = Counter(tuple(r) for r in jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(con.sql(op7_jaccard.SQL).fetchall()) and len({c for _, _, c in got}) < len(got)


def test_points_are_shuffled_with_pairs_of_like_size_only(spark):
    """Of 60 pairs 20 are of like size; only those go to the second join with a point in them."""
    shingles = [np.arange(n, dtype=np.uint64) for n in (10, 11, 40)]
    rows = [(k, len(s), op7_jaccard.point(s)) for k, s in zip(range(90), shingles * 30, strict=True)]
    points = spark.createDataFrame([(k, n, bytearray(p)) for k, n, p in rows], "sid long, n long, point binary")
    pairs = spark.createDataFrame([(k, k + step) for k in range(0, 60, 3) for step in (1, 2, 5)], "a long, b long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = op7_jaccard.bounded_pairs(pairs, points)
        assert {(r.a, r.b) for r in found.collect()} == {(k, k + 1) for k in range(0, 60, 3)}

        def walk(node):
            name = node.nodeName()
            if name.startswith("AdaptiveSparkPlan"):
                return walk(node.executedPlan())
            if "QueryStage" in name:
                return walk(node.plan())
            wide = name == "Exchange" and "a_point" in node.output().toString() and "b#" in node.output().toString()
            own = [node.metrics().get("shuffleRecordsWritten").get().value()] if wide else []
            children = node.children()
            return own + [n for k in range(children.size()) for n in walk(children.apply(k))]

        assert walk(found._jdf.queryExecution().executedPlan()) == [20]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
