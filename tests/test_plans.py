"""Physical plans: what must be there at scale and what must not."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliospark.operators import joins, skew, windows
from foliospark.operators.reduction import ReductionPolicy
from foliospark.operators.skew import SkewPolicy
from foliospark.plans import accounts, attributes, grouped, tracking
from foliospark.plans.params import TrackingParams
from foliospark.sources import io
from queries import operators
from queries.mapping import Inputs
from queries.steps import MANY
from tests.conftest import bag

SF = "/root/testdata/sf0.001"
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF, MANY)


@pytest.fixture(scope="module")
def tracked(inputs):
    return tracking.build_tracking(inputs)


def test_no_cross_join_and_no_python(tracked):
    text = plan(tracked)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not any(p in text for p in PYTHON)


def test_grouped_reads_few_columns(spark, tracked, tmp_path):
    path = str(tmp_path / "tracking")
    io.write_replace(tracked, path, partition_by="FechaFoto")
    stored = spark.read.parquet(path)
    report = grouped.portfolio_grouped(stored)
    physical = report._jdf.queryExecution().executedPlan().toString()
    assert "TramoDeuda:" not in physical and "CambiosTotal:" not in physical
    assert bag(report) == bag(grouped.portfolio_grouped(tracked))


def test_top_n_trims_before_the_shuffle(spark):
    t = Inputs(spark, SF)
    text = plan(windows.top_n(t("events"), ["user_id"], [F.col("ts").asc()], 10))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_filters_reach_the_scan(spark):
    t = Inputs(spark, SF)
    text = plan(operators.QUERIES["q_snapshot_in_list"](spark, SF)) + plan(io.date_range(t("lineitem"), "l_shipdate", "1996-01-01"))
    assert "PushedFilters: [In(o_orderdate" in text
    assert "GreaterThanOrEqual(l_shipdate" in text


def test_same_key_joins_share_one_shuffle(spark):
    t = Inputs(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = operators.cells(t).withColumnRenamed("v", "x")
        sides = [(operators.cells(t, s).select("k", "m", F.col("v").alias(s)), ["k", "m"]) for s in "FOP"]
        joined = joins.enrich(base, sides)
        physical = joined._jdf.queryExecution().executedPlan().toString()
        # the four groupings shuffle once each; the joins on the same key add nothing
        assert physical.count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_job_with_everything_hot(spark, inputs, tracked):
    """The split routes of every step give the same tracking table, numbers of repeats included."""
    tight = TrackingParams(skew=SkewPolicy(piece_rows=3))
    assert bag(tracking.build_tracking(inputs, tight)) == bag(tracked)


def test_three_counting_jobs_and_one_panel_shuffle(spark, inputs, monkeypatch):
    counted, real = [], skew.hot_lists
    for module in (accounts, attributes, tracking):
        monkeypatch.setattr(module, "hot_lists", lambda asked, policy: counted.append(sorted(asked)) or real(asked, policy))
    tracking.build_tracking(inputs)
    assert len(counted) == 3
    panel = accounts.account_panel(accounts.panel_rows(inputs("account_month_old"), inputs("account_month")))
    physical = panel._jdf.queryExecution().executedPlan().toString()
    # the derived inputs have shuffles of their own, below the union
    assert physical[: physical.index("Union")].count("Exchange") == 1


def test_upload_dates_reach_the_scan(spark, inputs, tmp_path):
    """On stored inputs, the history that no opening can look back to is not read; the log is scanned once."""
    for name in ("vehicles", "houses", "real_estate_month", "client_master", "application_log", "openings"):
        (inputs(name) if name != "openings" else tracking.build_stock(inputs)[1]).write.parquet(str(tmp_path / name))
    table = lambda name: spark.read.parquet(str(tmp_path / name))
    master = attributes.master_ids(table("client_master"))
    for df in (
        attributes.vehicle_wealth(table("openings"), table("vehicles"), master),
        attributes.property_wealth(table("openings"), table("real_estate_month"), table("houses"), master),
    ):
        text = plan(df)
        assert "GreaterThanOrEqual(upload_dt,2020-01-01" in text and "LessThan(upload_dt,2022-01-01" in text
    assert plan(attributes.last_application(table("openings"), table("application_log"))).count("/application_log]") == 0  # read when it was stored


def test_a_run_leaves_nothing_behind_and_months_are_split(spark, inputs, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "foliospark"
    before = {p.name for p in shared.iterdir()}
    paths = tracking.run_tracking(inputs, spark, str(tmp_path / "out"))
    assert {p.name for p in shared.iterdir()} == before
    stored = spark.read.parquet(paths["tracking"])
    assert bag(spark.read.parquet(paths["portfolio_grouped"])) == bag(grouped.portfolio_grouped(stored)) and stored.count()
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64k")
    try:
        one = spark.range(200_000).selectExpr("1 AS month", "id", "uuid() AS u").unionByName(spark.range(10).selectExpr("2 AS month", "id", "uuid() AS u"))
        io.write_replace(one, str(tmp_path / "months"), partition_by="month")
    finally:
        spark.conf.unset(key)
    assert len(list((tmp_path / "months" / "month=1").glob("*.parquet"))) > 3 and len(list((tmp_path / "months" / "month=2").glob("*.parquet"))) == 1


def nodes(df):
    """(depth, text) of the physical nodes, from the top; a node stands above what it reads."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    clean = [line.replace("*", " ") for line in lines if line.strip()]
    return [(len(line) - len(line.lstrip(" +-:")), line.lstrip(" +-:").split(") ", 1)[-1] if line.lstrip(" +-:").startswith("(") else line.lstrip(" +-:")) for line in clean]


def above(found, k):
    """What stands above node ``k``, the nearest first."""
    depth, out = found[k][0], []
    for d, text in reversed(found[:k]):
        if d < depth:
            depth = d
            out.append(text)
    return out


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_buckets_are_not_shuffled_again(spark, inputs, no_broadcasts):
    """Outcomes need no exchange at all, and the openings none for what is joined by account and month."""
    panel, stock = tracking.build_stock(inputs)
    outcomes = attributes.vintage_outcomes(stock, panel)
    assert not [t for _, t in nodes(outcomes) if t.startswith("Exchange")]
    with io.co_located(spark):
        called = attributes.last_application(stock, inputs("application_log")).withColumnRenamed("IdCliente", "__called")
        joined = joins.enrich(stock, [(outcomes.drop("IdCliente"), tracking.CONTRACT), (called, tracking.CONTRACT)])
        found = nodes(joined)
        tables = [k for k, (_, t) in enumerate(found) if t.startswith("FileScan") and ("_panel_" in t or "_openings_" in t)]
        # the openings as base, the openings and the panel below the outcomes; others of the openings ask for applications
        assert len(tables) == 5
        assert [any(a.startswith("Exchange") for a in above(found, k)) for k in tables] == [False, False, False, True, True]
        assert bag(joined.select("Contrato", "FechaFoto", "MesesConVintageMes12", "DRegistro")) == bag(
            stock.join(outcomes.drop("IdCliente"), tracking.CONTRACT, "left").join(called, tracking.CONTRACT, "left").select("Contrato", "FechaFoto", "MesesConVintageMes12", "DRegistro")
        )


def test_the_panel_is_packed_before_it_is_joined(spark, inputs):
    panel, stock = tracking.build_stock(inputs)
    found = nodes(attributes.vintage_outcomes(stock, panel))
    (scan,) = [k for k, (_, t) in enumerate(found) if t.startswith("FileScan") and "_panel_" in t]
    chain = [a for a in above(found, scan) if "Join" in a or "Aggregate" in a]
    assert chain[0].startswith("HashAggregate(keys=[Contrato") and sum("Join" in a for a in chain) == 1


@pytest.mark.parametrize("params", [TrackingParams(reduction=ReductionPolicy(exact_keys=0)), TrackingParams(buckets=0)])
def test_whole_job_with_bloom_filters_and_without_buckets(inputs, tracked, params):
    assert bag(tracking.build_tracking(inputs, params)) == bag(tracked)


def shuffled(spark, df):
    """Rows that the exchanges of a query have written."""
    df.write.format("noop").mode("overwrite").save()
    df = df.select("*")
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().get("shuffleRecordsWritten").get().value() if name == "Exchange" else 0
        children = node.children()
        return own + sum(walk(children.apply(k)) for k in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("policy", [ReductionPolicy(), ReductionPolicy(exact_keys=0)])
def test_histories_are_reduced_before_they_are_shuffled(spark, policy):
    t = Inputs(spark, "/root/testdata/sf0.01", MANY)
    panel, stock = tracking.build_stock(t)
    stock = io.store(stock.filter("IdCliente % 100 = 1"), "openings")
    master = attributes.master_ids(t("client_master"))
    bureau, vehicles = (io.store(t(n), n) for n in ("bureau_month", "vehicles"))
    clients, owners, _ = tracking.key_filters(stock, master, accounts.client_ids(t("client_id_map")), TrackingParams(reduction=policy))
    pairs = [
        (attributes.bureau_windows(bureau, hot=None), attributes.bureau_windows(bureau, hot=None, clients=clients)),
        (attributes.vehicle_totals(vehicles, master), attributes.vehicle_totals(vehicles, master, owners=owners)),
    ]
    for whole, reduced in pairs:
        found = nodes(reduced)
        last = max(k for k, (_, x) in enumerate(found) if x.startswith("Exchange hashpartitioning"))
        assert any(x.startswith("BroadcastHashJoin") for _, x in found[last:])
        # id lists go through an exchange of their own where they are translated
        assert shuffled(spark, whole) >= 20 * max(1, shuffled(spark, reduced) - master.count())
        of = clients.reduce(whole, "IdCliente")
        assert bag(of) == bag(clients.reduce(reduced, "IdCliente")) and of.count()
