"""Reduction to the keys that matter, and packed monthly histories, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators.history import Months, ahead, amount_at, packed
from foliospark.operators.reduction import KeyFilter, ReductionPolicy, key_filter
from tests.conftest import bag, frame

BLOOM = ReductionPolicy(exact_keys=0)


@pytest.mark.parametrize("policy", [ReductionPolicy(), BLOOM, ReductionPolicy(exact_keys=0, most_words=1)])
@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_no_key_is_held_back(spark, policy, kind):
    keys = spark.range(0, 400, 4).select(F.col("id").cast(kind).alias("k")).unionByName(spark.sql(f"SELECT cast(NULL AS {kind}) AS k"))
    rows = spark.range(2000).select((F.col("id") % 500).cast(kind).alias("k"), "id", F.lit(1).alias("__x"))
    rows = rows.unionByName(spark.sql(f"SELECT cast(NULL AS {kind}) AS k, 1L AS id, 1 AS __x"))
    kept = key_filter(keys, "k", policy).reduce(rows, "k")
    assert kept.columns == rows.columns
    wanted = rows.join(keys.distinct(), "k", "left_semi")
    assert not bag(wanted.select(rows.columns)) - bag(kept) and kept.filter("k IS NULL").count() == 0
    if policy.most_words > 1:
        assert kept.count() <= 1.1 * wanted.count()


def test_whole_numbers_of_any_width_are_alike(spark):
    assert key_filter(spark.range(3), "id", BLOOM).reduce(spark.range(10).select(F.col("id").cast("int").alias("k")), "k").count() >= 3


def test_share_of_wrong_positives(spark):
    found = key_filter(spark.range(50_000), "id", BLOOM)
    assert found.bits == 16384
    wrong = found.reduce(spark.range(1_000_000, 1_200_000), "id").count() / 200_000
    assert wrong < 0.02


def test_a_filter_that_is_too_full_is_none(spark):
    policy = ReductionPolicy(exact_keys=10, most_words=4)
    found = key_filter(spark.range(1000), "id", policy)
    assert found == KeyFilter(None) and found.reduce(spark.range(7), "id").count() == 7


def test_empty_keys(spark):
    assert key_filter(spark.range(0), "id").reduce(spark.range(7), "id").count() == 0


@pytest.mark.parametrize("first,last", [(dt.date(2021, 1, 1), dt.date(2023, 4, 1)), (dt.date(2001, 5, 1), dt.date(2014, 2, 1))])
def test_histories(spark, first, last):
    months = Months(first, last)
    r = random.Random(months.count)
    day = lambda k: (first.replace(day=1) if k == 0 else dt.date(first.year + (first.month - 1 + k) // 12, (first.month - 1 + k) % 12 + 1, 1))
    rows = [(r.choice("abcd") if r.random() < 0.9 else None, day(r.randrange(months.count)), r.choice([True, False, None]), r.choice([None, 0.0, 1.5, 7.0])) for _ in range(400)]
    df = frame(spark, "k string, m date, f boolean, a double", rows)
    histories = packed(df, "k", "m", months, {"f": F.col("f")}, {"a": F.col("a")})
    assert histories.count() == len({k for k, *_ in rows if k})
    asked = frame(spark, "q string, n date", [(k, day(j)) for k in "abcdz" for j in range(months.count)])
    read = asked.join(histories, asked.q == histories.k, "left").withColumn("at", months.place("n"))
    out = read.select("q", "n", *[ahead(b, "at", h).alias(f"{b}{h}") for b in ("seen", "f") for h in (0, 2, 12, 63)], *[amount_at("a", "at", h).alias(f"a{h}") for h in (0, 3, 12)])
    for row in out.collect():
        at = (row.n.year - first.year) * 12 + row.n.month - first.month
        own = [((m.year - first.year) * 12 + m.month - first.month - at, f, a) for k, m, f, a in rows if k == row.q]
        for h in (0, 2, 12, 63):
            bits = lambda keep: sum({1 << (o) for o, f, _ in own if 0 <= o <= h and keep(f)})
            signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
            assert row[f"seen{h}"] == signed(bits(lambda f: True)) and row[f"f{h}"] == signed(bits(lambda f: f))
        for h in (0, 3, 12):
            assert row[f"a{h}"] == max((a for o, _, a in own if o == h and a is not None), default=None)


def test_a_month_outside_is_an_error(spark):
    months = Months(dt.date(2021, 1, 1), dt.date(2021, 12, 1))
    df = frame(spark, "k string, m date", [("a", dt.date(2022, 1, 1))])
    with pytest.raises(Exception, match="month outside"):
        packed(df, "k", "m", months, {}, {}).collect()
