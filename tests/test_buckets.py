"""Stored buckets: what is dealt by client once is not shuffled again, and tasks don't grow with the tables."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import skew
from foliospark.operators.skew import SkewPolicy
from foliospark.plans import attributes, tracking
from foliospark.plans.params import TrackingParams
from foliospark.sources import io
from queries import mapping, steps
from queries.mapping import Inputs
from tests.conftest import bag
from tests.test_plans import above, no_broadcasts, nodes  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture
def inputs(spark, monkeypatch):
    monkeypatch.setattr(mapping, "LINES", 400)
    return Inputs(spark, SF, steps.MANY)


def exchanges(df):
    return [text for _, text in nodes(df) if text.startswith("Exchange")]


def test_buckets_follow_the_lines(spark, inputs):
    assert inputs.buckets == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 400) > 8
    for name, client in mapping.BY_CLIENT.items():
        assert inputs(name).groupBy(client).count().rdd.getNumPartitions() == inputs.buckets


def test_inputs_of_clients_need_no_shuffle(inputs, no_broadcasts):  # noqa: F811
    for name in ("bureau_month", "preapproval_scores", "retail_spend_s", "income_logic", "mini_policy", "account_month"):
        assert not exchanges(inputs(name)), name


def test_bureau_rows_are_stored_once_by_client(inputs, no_broadcasts):  # noqa: F811
    plain = attributes.bureau_windows(inputs("bureau_month"))
    dealt = attributes.bureau_windows(inputs("bureau_month"), buckets=inputs.buckets)
    assert not exchanges(dealt) and bag(dealt) == bag(plain)
    tight = TrackingParams(skew=SkewPolicy(piece_rows=3))
    assert bag(attributes.bureau_windows(inputs("bureau_month"), tight, buckets=inputs.buckets)) == bag(plain)


def test_only_tables_with_a_large_bucket_are_counted(spark):
    even = io.store_bucketed(spark.range(40).select((F.col("id") % 20).alias("k")), "even", "k", 4)
    one = io.store_bucketed(spark.range(40).select(F.lit(1).alias("k")), "one", "k", 4)
    assert skew.crowded({"even": even, "one": one}, SkewPolicy(piece_rows=30)) == {"one"}
    assert skew.crowded({"even": even}, SkewPolicy(piece_rows=2)) == {"even"}
    assert skew.hot_lists({}) == {}


def test_attributes_of_clients_are_joined_where_they_lie(spark, inputs, no_broadcasts):  # noqa: F811
    params = TrackingParams(buckets=inputs.buckets)
    panel, stock = tracking.build_stock(inputs, params)
    with io.co_located(spark):
        tables, right_hot = tracking.build_attributes(inputs, panel, stock, params)
        found = nodes(tracking.enriched(stock, tables, right_hot=right_hot, params=params))
        for name in ("preapproval_grade_restated", "mini_policy", "estimated_income", "bureau_rows", "vehicle_wealth", "retail_spend"):
            (scan,) = [k for k, (_, t) in enumerate(found) if t.startswith("FileScan") and f"foliospark_{name}_" in t]
            # only the wide base moves, once, back to the accounts
            assert sum(a.startswith("Exchange") for a in above(found, scan)) == 1, name
        (scan,) = [k for k, (_, t) in enumerate(found) if t.startswith("FileScan") and "foliospark_provision_pd_" in t]
        assert not any(a.startswith("Exchange") for a in above(found, scan))


def test_the_day_of_a_time_is_found_once(spark, inputs):
    """The stored lines and orders hold days, so no grouping converts times; a time of day changes no input."""
    for name, columns in mapping.DAYS.items():
        assert {dict(inputs(name).dtypes)[c] for c in columns} == {"date"}
    timed = Inputs(spark, SF, steps.MANY)
    for name, column in (("lineitem", "l_shipdate"), ("orders", "o_orderdate")):
        timed._known[name] = inputs(name).withColumn(column, F.col(column) + F.expr("INTERVAL 23 HOURS"))
    for name in ("account_month", "bureau_month", "preapproved_base"):
        assert bag(timed(name)) == bag(inputs(name))
