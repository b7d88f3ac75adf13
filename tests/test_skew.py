"""The split routes give what the plain routes give, with most rows under few or under many keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.operators import skew
from foliospark.plans import attributes
from foliospark.plans.params import TrackingParams
from tests.conftest import bag, frame

TIGHT = skew.SkewPolicy(piece_rows=3)


def hot(df, *keys, policy=TIGHT):
    return skew.hot_lists({"x": (df, list(keys))}, policy)["x"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = []
    for i in range(400):
        key = r.choice(["hot", "hot", "hot", None, "a", "b", "c"] + [f"k{j}" for j in range(40)])
        data.append((i, key, r.randrange(6), r.choice([None, 1.0, 2.0, 3.0])))
    return frame(spark, "i int, k string, m int, v double", data).cache()


def test_every_hot_key_is_listed_with_its_pieces(rows):
    counts = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    ids = {r[1]: r.k for r in rows.select("k", skew.key_id(rows, ["k"])).distinct().collect()}
    found = {ids[r["__id"]]: r["__pieces"] for r in hot(rows, "k").collect()}
    assert found == {k: -(-n // 3) for k, n in counts.items() if n > 3} and len(found) > 30
    assert hot(rows, "k", policy=skew.SkewPolicy(1000)) is None


def test_one_job_for_several_tables_and_keys(spark, rows):
    other = frame(spark, "k bigint", [(1,)] * 9 + [(2,)])
    lists = skew.hot_lists({"k": (rows, ["k"]), "km": (rows, ["k", "m"]), "all": (rows, ["i"]), "o": (other, ["k"])}, TIGHT)
    assert lists["all"] is None and lists["o"].count() == 1 and lists["km"].count() > lists["k"].filter("__pieces > 5").count()
    narrow = frame(spark, "k int", [(1,)])
    assert narrow.select(skew.key_id(narrow, ["k"])).first()[0] == lists["o"].first()["__id"]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_with_hot_rows_on_the_left(spark, rows, how):
    right = frame(spark, "k string, w int, x int", [("hot", 1, 0), ("hot", 3, 1), ("a", 2, 2), (None, 0, 3), ("zz", 0, 4)])
    cond = lambda: F.col("w") <= F.col("m")
    salted = skew.skew_join(rows, right, ["k"], how, residual=cond, hot=hot(rows, "k"))
    r = right.withColumnRenamed("k", "rk")
    plain = rows.join(r, (F.col("k") == F.col("rk")) & (F.col("w") <= F.col("m")), how).drop("rk")
    assert bag(salted) == bag(plain) and salted.columns == plain.columns


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_with_hot_rows_on_either_side(spark, rows, how):
    right = frame(spark, "k string, x int", [("hot", j) for j in range(40)] + [("a", j) for j in range(9)] + [("b", 0), (None, 1), (None, 2), (None, 3), (None, 4), ("zz", 0)])
    other = frame(spark, "k string, y int", [(f"k{j}", n) for j in range(30) for n in range(6)] + [("hot", 1)])
    lists = [hot(right, "k"), hot(other, "k")]
    assert lists[1].count() == 30
    plain = rows.join(right, "k", how).join(other, "k", how)
    for left_list in (None, hot(rows, "k")):
        split = skew.skew_joins(rows, [right, other], ["k"], how, hot=left_list, right_hot=lists)
        assert bag(split) == bag(plain)
    with pytest.raises(ValueError):
        skew.skew_join(rows, right, ["k"], "left", right_hot=lists[0], residual=lambda: F.col("x") > F.col("m"))


def test_previous_row_equals_lag(rows):
    tie = F.xxhash64(*rows.columns)
    w = Window.partitionBy("k").orderBy("m", tie)
    expected = rows.withColumn("p", F.lag("v").over(w)).withColumn("q", F.lag("i").over(w))
    assert bag(skew.previous_row(rows, ["k"], "m", {"p": "v", "q": "i"}, hot(rows, "k"))) == bag(expected)
    assert bag(skew.previous_row(rows, ["k"], "m", {"p": "v", "q": "i"})) == bag(expected)


def test_previous_row_with_copies(spark, rows):
    """Copies of one row fill a hot key; the bag equals that of the plain lag."""
    few = rows.drop("i")
    copied = few.unionByName(few).unionByName(few.filter("k = 'hot'"))
    w = Window.partitionBy("k").orderBy("m", F.xxhash64(*copied.columns))
    expected = copied.withColumn("p", F.lag("v").over(w))
    assert bag(skew.previous_row(copied, ["k"], "m", {"p": "v"}, hot(copied, "k"))) == bag(expected)


def test_previous_row_skips_missing_months(spark):
    df = frame(spark, "k string, m int, v int", [("a", 1, 10), ("a", 2, 20), ("a", 5, 50)])
    assert bag(skew.previous_row(df, ["k"], "m", {"p": "v"}).select("m", "p")) == {(1, None): 1, (2, 10): 1, (5, 20): 1}


@pytest.mark.parametrize("way", ["asc", "desc"])
@pytest.mark.parametrize("part", [["k"], ["k", "m"]])
def test_row_numbers_are_the_same_on_both_routes(rows, way, part):
    few = rows.drop("i")
    copied = few.unionByName(few.filter("k = 'hot'")).unionByName(few.filter("k = 'hot'"))
    for df in (rows, copied):
        plain = skew.row_numbers(df, part, [("v", way)], "r")
        split = skew.row_numbers(df, part, [("v", way)], "r", hot(df, "k"), ["k"])
        assert bag(split) == bag(plain) and split.columns == plain.columns
        keys = F.col("v").desc_nulls_last() if way == "desc" else F.col("v").asc_nulls_first()
        coarse = df.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy(keys)).cast("bigint"))
        assert bag(split.select(*part, "v", "r")) == bag(coarse.select(*part, "v", "r"))


def test_bureau_windows_with_hot_clients(spark):
    r = random.Random(2)
    months = [f"20{20 + (5 + i) // 12}-{(5 + i) % 12 + 1:02d}-01" for i in range(16)]
    amount = lambda: r.choice([None, 0.0, 1.0, 2.0, 5.0])
    data = [(r.choice(months), r.choice([1, 1, 1, 2, 3, None]), amount(), amount(), amount(), amount()) for _ in range(250)]
    data += data[:20]  # repeated rows
    df = frame(spark, "m string, id_cliente bigint, linea_disp double, dconsumo double, dcomercial double, dhipotecar double", data)
    df = df.withColumn("fecha_foto", F.col("m").cast("date")).drop("m")
    plain = attributes.bureau_windows(df)
    salted = attributes.bureau_windows(df, TrackingParams(skew=TIGHT))
    assert bag(salted) == bag(plain)
