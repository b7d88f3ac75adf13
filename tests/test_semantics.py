"""Scalar and date behaviour on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliospark.functions import dates as fd
from foliospark.functions import scalars as fs
from foliospark.operators import rules
from foliospark.sources import io
from tests.conftest import bag, frame

D = dt.date


def values(spark, schema, rows, expr):
    df = frame(spark, schema, [(i, *r) for i, r in enumerate(rows)])
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_month_diff_counts_boundaries(spark):
    rows = [(D(2022, 2, 1), D(2022, 1, 31)), (D(2022, 2, 28), D(2022, 2, 1)), (D(2022, 1, 31), D(2022, 2, 1)), (None, D(2022, 2, 1)), (D(2023, 1, 1), D(2021, 12, 31))]
    assert values(spark, "i int, a date, b date", rows, fd.month_diff("a", "b")) == [1, 0, -1, None, 13]


def test_year_and_day_diff(spark):
    rows = [(D(2022, 1, 1), D(2021, 12, 31)), (D(2022, 12, 31), D(2022, 1, 1))]
    assert values(spark, "i int, a date, b date", rows, fd.year_diff("a", "b")) == [1, 0]
    assert values(spark, "i int, a date, b date", rows, fd.day_diff("a", "b")) == [1, 364]


def test_add_months_clamps(spark):
    rows = [(D(2022, 1, 31),), (D(2024, 1, 31),), (D(2022, 2, 28),)]
    assert values(spark, "i int, a date", rows, fd.add_months("a", 1)) == [D(2022, 2, 28), D(2024, 2, 29), D(2022, 3, 28)]


def test_month_end(spark):
    rows = [(D(2024, 2, 28),), (D(2024, 2, 29),), (None,)]
    assert values(spark, "i int, a date", rows, fd.is_month_end("a")) == [False, True, None]


def test_month_ends_list():
    assert fd.month_ends("2022-11-01", "2023-02-01") == [D(2022, 11, 30), D(2022, 12, 31), D(2023, 1, 31), D(2023, 2, 28)]


def test_safe_cast(spark):
    rows = [("",), ("null",), (None,), (" 7 ",), ("1.5",), ("12",)]
    assert values(spark, "i int, a string", rows, fs.safe_cast("a", "bigint")) == [None, None, None, 7, None, 12]
    assert values(spark, "i int, a string", [("2022-02-30",), ("2022-02-03",)], fs.safe_cast("a", "date")) == [None, D(2022, 2, 3)]


def test_strict_cast_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(spark, "i int, a string", [("x",)], F.col("a").cast("bigint"))


def test_to_int_rounds(spark):
    assert values(spark, "i int, a double", [(2.5,), (-2.5,), (2.4,), (None,)], fs.to_int("a")) == [3, -3, 2, None]


def test_strict_least(spark):
    rows = [(1, 0), (1, 1), (None, 0), (0, None)]
    assert values(spark, "i int, a int, b int", rows, fs.strict_least("a", "b")) == [0, 1, None, None]


def test_floor_zero(spark):
    assert values(spark, "i int, a double", [(5.0,), (-5.0,), (None,)], fs.floor_zero("a")) == [5.0, 0.0, 0.0]


def test_clean_amount(spark):
    rows = [("",), ("  ",), ("null",), (None,), (" 1500 ",), ("\t20.5\n",)]
    assert values(spark, "i int, a string", rows, fs.clean_amount("a")) == [0.0, 0.0, 0.0, 0.0, 1500.0, 20.5]


def test_year_text(spark):
    rows = [("2015",), ("1500",), (None,), ("0",)]
    assert values(spark, "i int, a string", rows, fd.year_text_to_date("a")) == [D(2015, 1, 1), D(1900, 1, 1), D(1900, 1, 1), D(1900, 1, 1)]


def test_datetime_text(spark):
    assert values(spark, "i int, a string", [("2022-03-04 23:59:58",), ("2022-03-04",)], fd.datetime_text_to_date("a")) == [D(2022, 3, 4)] * 2


def test_ratio_or(spark):
    rows = [(1.0, 3.0), (0.0, 0.0), (None, 1.0), (1.0, None)]
    a, b = F.col("a"), F.col("b")
    assert values(spark, "i int, a double, b double", rows, fs.ratio_or(a, a + b, a.isNull(), -1.0)) == [0.25, -1.0, -1.0, None]


def test_codes(spark):
    assert values(spark, "i int, a string", [("C",), ("E",), (None,)], fs.nationality_from_letter("a")) == [152, 999, 999]
    assert values(spark, "i int, a string", [("CL",), ("604",), (None,)], fs.nationality_from_code("a")) == [152, 604, None]


def test_not_in_drops_null(spark):
    df = frame(spark, "a string", [("Temporal",), ("Robo",), (None,)])
    assert [r.a for r in df.filter(~F.col("a").isin("Temporal", "Fraude")).collect()] == ["Robo"]


def test_cohort_label(spark):
    rows = [(-2,), (-1,), (0,), (10,), (11,), (None,)]
    assert values(spark, "i int, k int", rows, rules.cohort_label(F.col("k"))) == ["M_Otros", "Mmenos1", "M0", "M10", "M_Otros", "M_Otros"]
    assert values(spark, "i int, k int", rows, rules.gated_by_offset(F.col("k"), F.lit(7))) == [0, 7, 7, 7, 0, 0]


def test_fresh_else(spark):
    rows = [(60, False), (61, False), (None, True), (None, False)]
    expr = rules.fresh_else(F.col("age"), F.lit("new"), F.lit("old"), F.lit("none"), F.col("missing"))
    assert values(spark, "i int, age int, missing boolean", rows, expr) == ["new", "old", "old", "none"]


def test_write_replace_round_trip(spark, tmp_path):
    df = frame(spark, "m date, k int", [(D(2022, 1, 1), 1), (D(2022, 2, 1), 2), (D(2022, 2, 1), 2), (None, 3)])
    path = str(tmp_path / "out")
    io.write_replace(df, path, partition_by="m")
    assert bag(spark.read.parquet(path)) == bag(df)
    fewer = df.filter("k = 2")
    io.write_replace(fewer, path)
    assert bag(spark.read.parquet(path)) == bag(fewer)


def test_store_uses_the_shared_folder(spark):
    stored = io.store(frame(spark, "k int", [(1,), (1,), (None,)]), "t")
    assert bag(stored) == {(1,): 2, (None,): 1}
    assert spark.conf.get("spark.checkpoint.dir") in stored.inputFiles()[0]
