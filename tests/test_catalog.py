"""Inputs by catalog name, and the partitions that snapshot lists leave to be read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliospark.functions.dates import month_ends
from foliospark.plans import accounts
from foliospark.sources import catalog, io
from foliospark.sources.inputs import INPUTS
from queries.mapping import Inputs
from tests.conftest import bag

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two inputs as catalog tables, the blocks in partitions by day."""
    t, folder = Inputs(spark, SF), tmp_path_factory.mktemp("tables")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS foliotest LOCATION '{folder}/db'")
    catalog.write_table(t("contract_blocks"), "spark_catalog.foliotest.contract_blocks", "fechacarga", str(folder / "blocks"))
    catalog.write_table(t("client_id_map").withColumnRenamed("id_cliente", "other"), "spark_catalog.foliotest.ids", path=str(folder / "ids"))
    yield t
    spark.sql("DROP DATABASE foliotest CASCADE")


def partitions_read(df):
    """Partitions that the scans of a query have read."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        found = node.metrics().get("numPartitions")
        own = found.get().value() if found.isDefined() and name.startswith("Scan") else 0
        children = node.children()
        return own + sum(walk(children.apply(k)) for k in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(autouse=True)
def whole_filters(spark):
    """Plans with their filters written out."""
    key = "spark.sql.maxMetadataStringLength"
    spark.conf.set(key, "2000")
    yield
    spark.conf.unset(key)


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inputs_by_name(spark, tables):
    by_schema = catalog.catalog_inputs(spark, "spark_catalog.foliotest")
    assert bag(by_schema("contract_blocks")) == bag(tables("contract_blocks"))
    assert by_schema("contract_blocks").columns == [x.split()[0] for x in INPUTS["contract_blocks"].split(", ")]
    by_name = catalog.catalog_inputs(spark, {"client_id_map": "spark_catalog.foliotest.ids"}, {"client_id_map": {"id_cliente": "other"}})
    assert bag(by_name("client_id_map")) == bag(tables("client_id_map"))
    with pytest.raises(KeyError):
        by_schema("nothing")
    for wrong in ("a.b", "a..b", "a"):
        with pytest.raises(ValueError):
            catalog.read_table(spark, wrong)


def test_month_ends_prune_partitions(spark, tables):
    """The month-end test of the blocks is answered from partition values."""
    blocks = catalog.catalog_inputs(spark, "spark_catalog.foliotest")("contract_blocks")
    kept = accounts.permanent_blocks(blocks)
    days = [r[0] for r in blocks.select("fechacarga").distinct().collect()]
    ends = [d for d in days if (d + dt.timedelta(days=1)).day == 1 and d >= dt.date(2022, 1, 1)]
    assert 0 < len(ends) < len(days)
    assert "last_day(fechacarga" in text(kept).split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert partitions_read(kept) == len(ends)
    assert bag(kept) == bag(accounts.permanent_blocks(tables("contract_blocks")))


def test_a_list_prunes_partitions(spark, tables):
    blocks = catalog.read_table(spark, "spark_catalog.foliotest.contract_blocks")
    ends = month_ends("2022-02-01", "2022-04-01")
    kept = io.snapshots(blocks, "fechacarga", ends)
    assert "PartitionFilters: [fechacarga" in text(kept) and partitions_read(kept) <= len(ends)


def test_a_joined_list_prunes_partitions_while_it_runs(spark, tables):
    blocks = catalog.read_table(spark, "spark_catalog.foliotest.contract_blocks")
    days = sorted(r[0] for r in blocks.select("fechacarga").distinct().collect())
    listed = io.store(spark.createDataFrame([(d, k % 3) for k, d in enumerate(days * 2)] + [(None, 0)], "d date, kind int"), "days").filter("kind = 1")
    kept = catalog.snapshots_listed(blocks, "fechacarga", listed, "d")
    wanted = {r[0] for r in listed.collect()}
    assert "dynamicpruning" in text(kept)
    assert partitions_read(kept.select("contratoalterno")) == len(wanted) < len(days)
    assert kept.columns == blocks.columns and bag(kept) == bag(blocks.filter(F.col("fechacarga").isin([str(d) for d in wanted])))


def test_a_long_list_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_DATES", 3)
    rows = spark.range(5).select(F.expr("date_add(DATE '2022-01-01', cast(id AS int))").alias("d"))
    with pytest.raises(ValueError):
        catalog.snapshots_listed(rows, "d", rows, "d")


def test_names_go_with_the_run(spark):
    before = set(t.name for t in spark.catalog.listTables("default"))
    with io.run_folder(spark):
        io.store_bucketed(spark.range(10).withColumn("k", F.col("id").cast("string")), "some", "k", 2)
        io.store_partitioned(spark.range(10).withColumn("k", F.lit(1)), "others", "id")
        assert len(set(t.name for t in spark.catalog.listTables("default")) - before) == 2
    assert set(t.name for t in spark.catalog.listTables("default")) == before


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        values = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}
        get = classmethod(lambda cls, key, default=None: cls.values.get(key, default))

    class Session:
        conf, sparkContext, _jvm = Conf, Context, spark._jvm

    with pytest.raises(ValueError, match="one machine"):
        io.shared_folder(Session)
    Context.master = "local[4]"
    assert io.shared_folder(Session) == "file:/tmp/warehouse/_work"
    Context.master, Conf.values = "yarn", Conf.values | {"spark.checkpoint.dir": "hdfs://a/b/"}
    assert io.shared_folder(Session) == "hdfs://a/b"
    assert [io.on_one_machine(m) for m in ("local", "local[*]", "local-cluster[2,1,1024]", "yarn")] == [True, True, False, False]
