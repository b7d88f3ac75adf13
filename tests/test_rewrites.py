"""Rewritten steps equal the direct forms on random small inputs, repeated rows and NULLs included."""

import contextlib
import datetime as dt
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.operators import joins
from foliospark.operators.skew import SkewPolicy
from foliospark.plans import accounts, attributes, cohort, policy, tracking
from foliospark.plans.params import TrackingParams
from queries import literal
from queries.mapping import Inputs
from queries.steps import COHORT, MANY
from tests.conftest import bag, frame

TIGHT = TrackingParams(skew=SkewPolicy(piece_rows=3))
D = dt.date


def month(i):
    return D(2021 + i // 12, i % 12 + 1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_vintage(spark, seed):
    r = random.Random(seed)
    panel = [
        (month(r.randrange(20)), r.choice(["a", "b", "b", "c", "", None]), r.choice([None, -5.0, 0.0, 10000.0, 7.0]),
         r.choice([None, 0.0, 3.0]), r.choice([None, -1.0, 9999.0, 10000.0]), r.choice([None, 0, 29, 30, 60, 90]),
         r.choice([None, D(1800, 1, 1), D(2021, 5, 5)]))
        for _ in range(90)
    ]
    panel = frame(spark, "FechaFoto date, Contrato string, DeudaL1 double, DeudaL2 double, DeudaTotal double, DiasMora bigint, FechaUltimoMovimiento date", panel)
    stock = frame(spark, "FechaFoto date, IdCliente bigint, Contrato string", [(month(r.randrange(18)), r.choice([1, 2, None]), r.choice(["a", "b", "c", "z", ""])) for _ in range(25)])
    expected = bag(literal.vintage_outcomes(stock, panel))
    assert bag(attributes.vintage_outcomes(stock, panel)) == expected
    assert bag(attributes.vintage_outcomes(stock, panel, TIGHT)) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_bureau(spark, seed):
    r = random.Random(seed)
    amount = lambda: r.choice([None, 0.0, 1.0, 2.0])
    data = [(D(2020 + (4 + i) // 12, (4 + i) % 12 + 1, 1), r.choice([1, 2, None]), amount(), amount(), amount(), amount()) for i in [r.randrange(14) for _ in range(60)]]
    data += data[:10]
    df = frame(spark, "fecha_foto date, id_cliente bigint, linea_disp double, dconsumo double, dcomercial double, dhipotecar double", data)
    assert bag(attributes.bureau_windows(df)) == bag(literal.bureau_windows(df))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_renegotiated(spark, seed):
    r = random.Random(seed)
    events = [(r.choice(["a", "b", "c", ""]), D(2021, 1, 1) + dt.timedelta(r.randrange(120)), r.choice([96022, 1, 2, 3])) for _ in range(80)]
    events = frame(spark, "contrato string, fechaoperacion date, tipofac bigint", events)
    opened = [D(2021, 2, 10), D(2021, 2, 10), D(2021, 1, 31), D(2021, 4, 1)]
    stock = [(r.choice(["a", "b", "", None]), r.choice([*opened, None])) for _ in range(14)]
    stock = frame(spark, "ContratoAlterno string, FechaApertura date", stock)
    expected = bag(literal.renegotiated(events, stock))
    assert bag(accounts.renegotiated(events, stock)) == expected
    assert bag(accounts.renegotiated(events, stock, TIGHT)) == expected


def test_asof(spark):
    base = frame(spark, "k int, m date", [(1, month(12)), (1, month(12)), (2, month(12)), (3, month(12)), (4, month(12)), (5, month(13))])
    right = frame(spark, "k int, m date, v double", [
        (1, month(12), 1.0), (1, month(13), 9.0),  # same month wins, later months do not count
        (2, month(0), 2.0),  # twelve months back
        (3, month(11), 3.0), (3, month(11), 4.0), (3, month(2), 5.0),  # two in the latest month: the larger
        (5, month(0), 6.0),  # thirteen months back
    ])
    got = joins.asof_within(base, right, "k", "m", "v", 12)
    assert {r.k: r.v for r in got.collect()} == {1: 1.0, 2: 2.0, 3: 4.0, 4: None, 5: None} and got.count() == 5
    unbounded = joins.asof_within(base, right, "k", "m", "v", None)
    assert {r.k: r.v for r in unbounded.collect()}[5] == 6.0


def test_last_application_keeps_only_the_latest(spark):
    stock = frame(spark, "IdCliente bigint, Contrato string, FechaFoto date", [(1, "a", month(5)), (1, "a", month(8)), (2, "b", month(5)), (1, "c", month(5))])
    names = (
        "dregistro idcliente nsolic niacpreaprobado aiafpreaprobado aaevaleafnodename arsltdpolcategoria niasosolicsucapert aiprevmfirmaautoprev "
        "diaccocfecrenta ctiposolic niaprenta rentpromprev antprevision numcotival aexctacastigada niapavaluopropiedad niaptasacionvehiculo "
        "niapaniovehiculo iantecedentesdelasolicitudai anacionalidad fechacarga norigen"
    ).split()
    row = lambda when, client, origin=2: {"dregistro": when, "idcliente": client, "nsolic": when, "fechacarga": when[:10], "norigen": origin}
    logs = [row("2021-05-02 10:00:00", 1), row("2021-06-02 10:00:00", 1), row("2021-06-20 09:00:00", 1), row("2021-09-30 10:00:00", 1), row("2021-06-25 10:00:00", 1, 1)]
    types = {"idcliente": "bigint", "rentpromprev": "double", "antprevision": "bigint", "numcotival": "bigint", "norigen": "int"}
    log = frame(spark, ", ".join(f"{n} {types.get(n, 'string')}" for n in names), [tuple(x.get(n) for n in names) for x in logs])
    log = log.withColumn("fechacarga", F.col("fechacarga").cast("date"))
    got = attributes.last_application(stock, log).select("Contrato", "FechaFoto", "DRegistro", "IdCliente")
    june, september = ("a", month(5).isoformat(), "2021-06-20 09:00:00", 1), ("a", month(8).isoformat(), "2021-09-30 10:00:00", 1)
    expected = {("a", june[2], june[1], 1): 1, ("a", september[2], september[1], 1): 1, ("b", None, None, None): 1, ("c", june[2], june[1], 1): 1}
    assert bag(got) == expected


def test_last_application_and_as_of_equal_their_direct_forms(spark):
    t = Inputs(spark, "/root/testdata/sf0.001", MANY)
    _, stock = tracking.build_stock(t)
    got = attributes.last_application(stock, t("application_log"))
    assert bag(got) == bag(literal.last_application(stock, t("application_log")).select(got.columns)) and got.count()
    master = attributes.master_ids(t("client_master"))
    ours = attributes.vehicle_wealth(stock, t("vehicles"), master)
    assert bag(ours) == bag(literal.asof_within(stock, attributes.vehicle_totals(t("vehicles"), master), "TasacionTotal", 12))
    assert ours.filter("TasacionTotal > 0").count()


@pytest.mark.parametrize("seed", range(4))
def test_follow_up_from_histories(spark, seed):
    """Ordered histories give the rows of the steps one by one, several rows of a month and NULLs included."""
    r = random.Random(seed)
    schema = "fechacarga date, FechaFoto date, contrato string, idcliente bigint, fcupo double, fsaldeud double, moraac bigint"
    rows = [
        (None, month(r.randrange(14)), r.choice(["a", "b", "c", "d", "e", None]), r.choice([1, 2, 3, 4, None]), r.choice([None, 0.0, 1.0, 2.0, 3.0]), r.choice([None, 5.0, 9.0]), r.choice([None, 0, 30, 31]))
        for _ in range(60)
    ]
    panel = frame(spark, schema, rows)
    campaign = frame(spark, "IdCliente bigint, Aumento_Campania int", [(1, 1), (3, 1)])
    steps = cohort.increase_follow_up(cohort.first_increase(cohort.limit_changes(panel)), campaign, panel)
    assert bag(cohort.followed(cohort.increases_with_history(cohort.account_histories(panel)), campaign)) == bag(steps) and steps.count()


def test_the_study_reads_the_snapshots_once(spark, tmp_path):
    t = Inputs(spark, "/root/testdata/sf0.001")
    for name in ("cohort_month", "limit_campaign_stage1", "limit_campaign_stage2"):
        t(name).write.parquet(str(tmp_path / name))
    table = lambda name: spark.read.parquet(str(tmp_path / name))
    study = cohort.limit_cohort(table("cohort_month"), table("limit_campaign_stage1"), table("limit_campaign_stage2"), COHORT)
    text = study._jdf.queryExecution().executedPlan().toString()
    assert sum("fcupo" in line for line in text.splitlines() if "FileScan" in line) == 1
    assert text.lower().count("exchange hashpartitioning(contrato") == 1 and study.count()


def test_rules_as_bits_equal_their_arms(spark):
    """Every score at and around every bound, every group and NULL."""
    r = random.Random(2)
    bounds = sorted({x.above for x in [*policy.SPONTANEOUS, *policy.PREAPPROVED] if x.above is not None})
    scores = [None, 0.0, 1.0, float("nan"), *bounds, *[b + 1e-9 for b in bounds], *[b - 1e-9 for b in bounds]]
    schema = (
        "FechaFoto date, MarcaPreaprobado string, MarcaBancarizadoU06M int, RentaEvaluacion double, ComprasSU12M double, ComprasFU12M double, TenenciaPatrimonio int, "
        "TenenciaRetailML int, ClasificacionPreaprobados string, TipoEmpleo string, EdadMeses bigint, Nacionalidad string, ProbPreaprobados double, ProbPreaprobados_Antiguo double"
    )
    models = [None, "BANCARIZADO MAYOR 21", "NO BANCARIZADO MAYOR 21", "EXTRANJERO NO BANCARIZADO", "MENOR 21"]
    rows = [
        (r.choice([None, *[D(2022, m, 1) for m in range(1, 13)], D(2023, 1, 1), D(2023, 2, 1)]), r.choice([None, "Espontaneo", "Preaprobado", "x"]), r.choice([None, 0, 1, 2]),
         r.choice([None, 0.0, 1.0, 399999.9995, 400000.0]), r.choice([None, 0.0, 5.0, -5.0]), r.choice([None, 0.0, 5.0]), r.choice([None, 0, 1]), r.choice([None, 0, 1]), r.choice(models),
         r.choice([None, "Dueña de Casa", "Otros"]), r.choice([None, 251, 252, 299, 300, 500]), r.choice([None, "Extranjero", "Chileno"]), r.choice(scores), r.choice(scores))
        for _ in range(6000)
    ]
    df = frame(spark, schema, rows)
    codes = policy.waterfalls({"s": policy.SPONTANEOUS, "p": policy.PREAPPROVED})
    direct = {"s": literal.waterfall(policy.SPONTANEOUS), "p": literal.waterfall(policy.PREAPPROVED)}
    both = df.select("*", *[x.alias(f"{n}_{k}") for k, c in (("bits", codes), ("arms", direct)) for n, x in c.items()])
    assert both.filter("NOT s_bits <=> s_arms OR NOT p_bits <=> p_arms").count() == 0
    named = both.withColumns({"CambiosEspontaneo": F.col("s_bits"), "CambiosPreaprobadoSinT": F.when(F.rand(1) < 0.9, F.col("p_bits"))})
    totals = named.select(policy.total_changes().alias("found"), literal.total_changes().alias("direct"))
    assert totals.filter("NOT found <=> direct").count() == 0
    assert both.select("s_bits").distinct().count() > 15 and both.select("p_bits").distinct().count() > 15
    assert totals.select("found").distinct().count() > 12


def test_generated_code_of_the_rules_stays_small_enough_to_be_compiled(spark, tmp_path):
    """The largest generated method of both waterfalls stays below the 8,000 bytes over which the JVM only interprets."""
    df = spark.createDataFrame([], "MarcaBancarizadoU06M int, RentaEvaluacion double, ComprasSU12M double, ComprasFU12M double, TenenciaPatrimonio int, TenenciaRetailML int, ClasificacionPreaprobados string, TipoEmpleo string, EdadMeses bigint, Nacionalidad string, ProbPreaprobados double, ProbPreaprobados_Antiguo double")
    df.write.parquet(str(tmp_path / "rows"))
    codes = policy.waterfalls({"s": policy.SPONTANEOUS, "p": policy.PREAPPROVED})
    out, told = io.StringIO(), spark.read.parquet(str(tmp_path / "rows")).select(*[c.alias(n) for n, c in codes.items()])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(out):
            told.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000
