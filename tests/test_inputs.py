"""Declared input layouts against what the plans are given in the other tests."""

import pytest

from foliospark.sources.inputs import INPUTS, conform, read_input
from queries.mapping import SPARK_SOURCES, Inputs
from tests.conftest import bag, frame

SF = "/root/testdata/sf0.001"
OWN = {"lines", "cohort_month"}  # helpers of the mapping, not inputs


def test_every_input_is_declared():
    assert set(INPUTS) == set(SPARK_SOURCES) - OWN and len(INPUTS) == 29


@pytest.mark.parametrize("name", sorted(INPUTS))
def test_layout(spark, name):
    df = Inputs(spark, SF)(name)
    declared = conform(df, name)
    assert sorted(declared.columns) == sorted(df.columns)
    assert {f.name: f.dataType for f in declared.schema} == {f.name: f.dataType for f in df.schema}


def test_read_input_renames_and_casts(spark, tmp_path):
    df = frame(spark, "CLIENT int, extra string", [(1, "x"), (None, "y")])
    df.write.parquet(str(tmp_path / "limit_campaign_stage1.parquet"))
    got = read_input(spark, str(tmp_path), "limit_campaign_stage1", {"rut": "CLIENT"})
    assert got.schema.simpleString() == "struct<rut:bigint>" and bag(got) == {(1,): 1, (None,): 1}
