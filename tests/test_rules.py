"""Band edges, every reachable policy rule and the roll-up, against literal expectations."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from foliospark.operators import rules
from foliospark.plans import ladders, policy, tracking
from queries.checking_values import BANDS
from queries.checking_values import PREAPPROVED as PREAPPROVED_TEXT
from queries.checking_values import SPONTANEOUS as SPONTANEOUS_TEXT
from queries.oracle_steps import band_lines
from tests.conftest import frame

EDGES = {
    "PROBABILITY": [(-1.0, "01. <= 5%"), (0.05, "01. <= 5%"), (0.0500001, "02. >5 <=10%"), (0.1, "02. >5 <=10%"), (0.15, "03. >10 <=15%"), (0.2, "04. >15 <=20%"), (0.25, "05. >20 <=25%"), (0.2500001, "06. >25%"), (None, "06. >25%")],
    "GRADE": [(0.0120, "01. AAA"), (0.0121, "02. AA"), (0.0221, "03. A"), (0.0325, "04. B"), (0.0437, "05. C"), (0.0622, "06. D"), (0.0735, "07. E"), (0.0880, "08. F"), (0.1010, "09. G"), (0.1276, "10. H"), (1.0, "10. H"), (1.01, "Otros"), (None, "Otros")],
    "GRADE_BEFORE": [(0.0149, "01. AAA"), (0.0150, "02. AA"), (0.0320, "03. A"), (0.0550, "04. B"), (0.0800, "05. C"), (0.1020, "06. D"), (0.1542, "07. E"), (0.1736, "08. F"), (0.2030, "09. G"), (0.2397, "10. H"), (1.0, "10. H"), (1.01, "Otros"), (None, "Otros")],
    "CONSUMER_DEBT": [(0.0, "00. Sin deuda"), (-1.0, "01. < 100"), (99999.0, "01. < 100"), (100000.0, "02. 100-500"), (500000.0, "03. 500-1MM"), (1e6, "04. 1-5 MM"), (5e6, "05. 5-10MM"), (10e6, "06. 10-20MM"), (20e6, "07. 20-30MM"), (30e6, "08. 30-40MM"), (40e6, "09. 40-50MM"), (50e6, "10. >= 50MM")],
    "DEBT_RATIO": [(None, "00. Sin info"), (-1.0, "00. Sin info"), (0.1, "01. <= 10%"), (0.11, "02. 10-20%"), (0.2, "02. 10-20%"), (1.0, "10. 90-100%"), (1.01, "11. > 100%"), (-0.5, "01. <= 10%")],
    "DTI": [(-1.0, "00. Sin DTI"), (0.0999, "01. <= 10%"), (0.1, "02. 10-20%"), (0.2, "02. 10-20%"), (0.201, "03. 20-30%"), (1.0, "10. 90-100%"), (1.2, "11. 100-120%"), (1.5, "12. 120-150%"), (2.0, "13. 150-200%"), (2.01, "14. > 200%"), (None, "Otros")],
    "EVALUATED_INCOME": [(-5.0, "01. Sin renta"), (0.0, "01. Sin renta"), (1.0, "02. <= 300"), (300000.0, "02. <= 300"), (300001.0, "03. 300-=400"), (1000000.0, "09. 900-=1 MM"), (1200000.0, "10. 1-=1.2 MM"), (1500000.0, "11. 1.2-=1.5 MM"), (1700000.0, "12. 1.5-=1.7 MM"), (2000000.0, "13. 1.7-=2.0 MM"), (2000001.0, "14. > 2.0 MM")],
    "PILOT_INCOME": [(0.0, "01. Sin renta"), (300000.0, "02. <= 300"), (500000.0, "03. <=500"), (800000.0, "04. <=800"), (1500000.0, "05. <=1.5 MM"), (2000000.0, "06. <=2.0 MM"), (2000001.0, "07. > 2.0 MM")],
    "LIMIT": [(0.0, "01. Sin cupo"), (100000.0, "02. <= 100"), (100001.0, "03. 100-=300"), (300000.0, "03. 100-=300"), (400000.0, "04. 300-=400"), (1000000.0, "10. 900-=1 MM"), (2000000.0, "14. 1.7-=2.0 MM"), (2000001.0, "15. > 2.0 MM"), (None, "Otros")],
    "AGE": [(251.0, "01. < 21"), (252.0, "02. =21-25"), (299.0, "02. =21-25"), (300.0, "03. =25-30"), (899.0, "12. =70-75"), (900.0, "13. >= 75"), (None, "Otros")],
    "WEALTH": [(0.0, "00. Sin patrimonio"), (-1.0, "01. <= 10MM"), (10e6, "01. <= 10MM"), (20e6, "02. 10-20MM"), (50e6, "05. 40-50MM"), (100e6, "06. 50-100MM"), (100e6 + 1, "07. > 100MM"), (None, "Otros")],
}


@pytest.mark.parametrize("name", sorted(EDGES))
def test_band_edges(spark, name):
    df = frame(spark, "i int, x double, want string", [(i, x, w) for i, (x, w) in enumerate(EDGES[name])])
    rows = df.select("x", "want", rules.band("x", getattr(ladders, name)).alias("got")).collect()
    assert [(r.x, r.got) for r in rows] == [(r.x, r.want) for r in rows]


def by_hand(name, x):
    """The label of a value, from the values that the checking SQL has, in Python."""
    holds = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
    last = None
    for head, bound, label in band_lines(name):
        if head == "ELSE" or (head == "NULL" and x is None):
            last = label
            if head == "NULL":
                return label
        elif head != "NULL" and x is not None and holds[head](x, bound):
            return label
    return last


@pytest.mark.parametrize("name", sorted(BANDS))
def test_every_edge_of_every_band(spark, name):
    """At each cut, a little below and a little above it."""
    cuts = sorted({b for _, b, _ in band_lines(name) if b is not None})
    values = [None, -1e9, 1e12, *[x for b in cuts for x in (math.nextafter(b, -math.inf), b, math.nextafter(b, math.inf))]]
    df = frame(spark, "i int, x double", list(enumerate(values)))
    got = {r.i: r.band for r in df.select("i", rules.band("x", getattr(ladders, name)).alias("band")).collect()}
    assert got == {i: by_hand(name, x) for i, x in enumerate(values)}


def test_every_rule_has_its_checking_condition():
    for rows, text in ((policy.SPONTANEOUS, SPONTANEOUS_TEXT), (policy.PREAPPROVED, PREAPPROVED_TEXT)):
        assert [r.code for r in rows] == [line.split(" | ")[0].strip() for line in text.strip().splitlines()]


BASE = {
    "EdadMeses": 400, "TipoEmpleo": "Otros", "MarcaBancarizadoU06M": 1, "TenenciaPatrimonio": 1, "TenenciaRetailML": 1,
    "ComprasSU12M": 10.0, "ComprasFU12M": 0.0, "RentaEvaluacion": 1e6, "ClasificacionPreaprobados": None,
    "Nacionalidad": "Chileno", "ProbPreaprobados": 0.01, "ProbPreaprobados_Antiguo": 0.01,
}
SCHEMA = (
    "EdadMeses bigint, TipoEmpleo string, MarcaBancarizadoU06M int, TenenciaPatrimonio int, TenenciaRetailML int, ComprasSU12M double, "
    "ComprasFU12M double, RentaEvaluacion double, ClasificacionPreaprobados string, Nacionalidad string, ProbPreaprobados double, ProbPreaprobados_Antiguo double"
)
NEW, OLD, NB = "ProbPreaprobados", "ProbPreaprobados_Antiguo", {"MarcaBancarizadoU06M": 0}
NOTHING = {"TenenciaPatrimonio": 0, "TenenciaRetailML": 0, "ComprasSU12M": 0.0}
SPEND_ONLY = {"TenenciaPatrimonio": 0, "TenenciaRetailML": 0}  # in neither the holding nor the no-info group
YOUNG, FOREIGN = {"EdadMeses": 299}, {"Nacionalidad": "Extranjero"}


def model(name):
    return {"ClasificacionPreaprobados": name}


B, N, E, M = (model(x) for x in ("BANCARIZADO MAYOR 21", "NO BANCARIZADO MAYOR 21", "EXTRANJERO NO BANCARIZADO", "MENOR 21"))

SPONTANEOUS = [
    ({}, "APROBADO FEBRERO23"),
    ({OLD: 0.25, NEW: 0.09}, "APROBADO FEBRERO23"),
    ({OLD: 0.26}, "RECHAZO POLITICA MAYO22 PD>0.25"),
    ({"RentaEvaluacion": 399999.0}, "RECHAZO POLITICA MAYO22 RENTA"),
    ({"RentaEvaluacion": 0.0}, "APROBADO FEBRERO23"),
    ({"TipoEmpleo": "Dueña de Casa"}, "RECHAZO POLITICA MAYO22 DUEÑA DE CASA"),
    ({"EdadMeses": 251}, "RECHAZO POLITICA MAYO22 EDAD<21"),
    (YOUNG | {OLD: 0.16}, "RECHAZO POLITICA MAYO22 EDAD<25"),
    (M, "RECHAZO MODELO MAYO22 MENOR 21"),
    (YOUNG | {NEW: 0.11}, "RECHAZO POLITICA OCTUBRE22 EDAD<25"),
    ({NEW: 0.14}, "RECHAZO POLITICA OCTUBRE22 BANCARIZADO"),
    (NB | {NEW: 0.14}, "RECHAZO POLITICA OCTUBRE22 NB ConInfo"),
    (NB | NOTHING | {NEW: 0.11}, "RECHAZO POLITICA OCTUBRE22 NB SinInfo"),
    (NB | SPEND_ONLY | B | {NEW: 0.14}, "RECHAZO MODELO OCTUBRE22 BANCARIZADO"),
    (NB | N | {NEW: 0.11}, "RECHAZO MODELO OCTUBRE22 NOBANCARIZADO"),
    (NB | E | {NEW: 0.11}, "RECHAZO MODELO OCTUBRE22 EXTRANJERO NB"),
    ({NEW: 0.125}, "RECHAZO POLITICA NOVIEMBRE22 BANCARIZADO"),
    (NB | {NEW: 0.125}, "RECHAZO POLITICA NOVIEMBRE22 NB ConInfo"),
    (NB | NOTHING | {NEW: 0.095}, "RECHAZO POLITICA NOVIEMBRE22 NB SinInfo"),
    (NOTHING | FOREIGN, "RECHAZO POLITICA FEBRERO23 NB SinInfo Extranjero"),
    (NOTHING | {NEW: 0.095}, "RECHAZO POLITICA FEBRERO23 NB SinInfo Chileno"),
    (YOUNG | {NEW: 0.095}, "RECHAZO POLITICA FEBRERO23 EDAD<25"),
    (YOUNG | NB | NOTHING | FOREIGN | {NEW: 0.08}, "RECHAZO POLITICA FEBRERO23 EDAD<25 SinInfo Extranjero"),
    ({NEW: None, OLD: None}, "APROBADO FEBRERO23"),
]
# an earlier rule takes every account these could apply to
SPONTANEOUS_UNREACHED = {
    "RECHAZO POLITICA MAYO22 BANCARIZADO", "RECHAZO POLITICA MAYO22 NB ConInfo", "RECHAZO POLITICA MAYO22 NB SinInfo",
    "RECHAZO MODELO MAYO22 BANCARIZADO", "RECHAZO MODELO MAYO22 NOBANCARIZADO", "RECHAZO MODELO MAYO22 EXTRANJERO NB",
    "RECHAZO MODELO NOVIEMBRE22 BANCARIZADO", "RECHAZO MODELO NOVIEMBRE22 NOBANCARIZADO", "RECHAZO MODELO NOVIEMBRE22 EXTRANJERO NB",
}
PREAPPROVED = [
    ({}, "APROBADO FEBRERO23"),
    (YOUNG | {OLD: 0.16}, "RECHAZO POLITICA AGOSTO22 EDAD<25"),
    ({OLD: 0.21}, "RECHAZO POLITICA AGOSTO22 Bancarizado"),
    (NB | {OLD: 0.21}, "RECHAZO POLITICA AGOSTO22 NBConPatRet"),
    (NB | NOTHING | {OLD: 0.17}, "RECHAZO POLITICA AGOSTO22 NBSinPatRet"),
    (YOUNG | {NEW: 0.115}, "RECHAZO POLITICA OCTUBRE22 EDAD<25"),
    ({NEW: 0.14}, "RECHAZO POLITICA OCTUBRE22 BANCARIZADO"),
    (NB | {NEW: 0.14}, "RECHAZO POLITICA OCTUBRE22 NB ConInfo"),
    (NB | NOTHING | {NEW: 0.11}, "RECHAZO POLITICA OCTUBRE22 NB SinInfo"),
    (M | {NEW: 0.095}, "RECHAZO MODELO OCTUBRE22 EDAD<21"),
    (YOUNG | {NEW: 0.105}, "RECHAZO POLITICA NOVIEMBRE22 EDAD<25"),
    ({NEW: 0.125}, "RECHAZO POLITICA NOVIEMBRE22 BANCARIZADO"),
    (NB | {NEW: 0.125}, "RECHAZO POLITICA NOVIEMBRE22 NB ConInfo"),
    (NB | NOTHING | {NEW: 0.095}, "RECHAZO POLITICA NOVIEMBRE22 NB SinInfo"),
    (NB | SPEND_ONLY | B | {NEW: 0.125}, "RECHAZO MODELO NOVIEMBRE22 BANCARIZADO"),
    (NB | SPEND_ONLY | N | {NEW: 0.125}, "RECHAZO MODELO NOVIEMBRE22 NOBANCARIZADO"),
    (NB | SPEND_ONLY | E | {NEW: 0.125}, "RECHAZO MODELO NOVIEMBRE22 EXTRANJERO NB"),
    (M | {NEW: 0.085}, "RECHAZO MODELO NOVIEMBRE22 EDAD<21"),
    (NOTHING | FOREIGN, "RECHAZO POLITICA FEBRERO23 NB SinInfo Extranjero"),
    (NOTHING | {NEW: 0.095}, "RECHAZO POLITICA FEBRERO23 NB SinInfo Chileno"),
    (YOUNG | {NEW: 0.095}, "RECHAZO POLITICA FEBRERO23 EDAD<25"),
    (YOUNG | NB | NOTHING | FOREIGN | {NEW: 0.08}, "RECHAZO POLITICA FEBRERO23 EDAD<25 SinInfo Extranjero"),
]
PREAPPROVED_UNREACHED = {
    "RECHAZO MODELO OCTUBRE22 BANCARIZADO", "RECHAZO MODELO OCTUBRE22 NOBANCARIZADO", "RECHAZO MODELO OCTUBRE22 EXTRANJERO NB",
}


@pytest.mark.parametrize(
    "table, cases, unreached",
    [(policy.SPONTANEOUS, SPONTANEOUS, SPONTANEOUS_UNREACHED), (policy.PREAPPROVED, PREAPPROVED, PREAPPROVED_UNREACHED)],
)
def test_waterfall(spark, table, cases, unreached):
    rows = [(i, *[(BASE | change)[c] for c in BASE], want) for i, (change, want) in enumerate(cases)]
    df = frame(spark, "i int, " + SCHEMA + ", want string", rows)
    got = df.select("i", "want", policy.waterfall(table).alias("got")).orderBy("i").collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]
    assert {r.code for r in table} == ({w for _, w in cases} - {"APROBADO FEBRERO23"}) | unreached


D = dt.date
ROLL_UP = [
    ("Espontaneo", D(2022, 4, 1), "RECHAZO POLITICA MAYO22 RENTA", "x", "RECHAZADO MAYO22"),
    ("Espontaneo", D(2022, 5, 1), "RECHAZO POLITICA MAYO22 RENTA", "x", "RECHAZADO MAYO22 FECHAS"),
    ("Espontaneo", D(2022, 9, 1), "RECHAZO MODELO OCTUBRE22 NOBANCARIZADO", "x", "RECHAZADO OCTUBRE22"),
    ("Espontaneo", D(2022, 10, 1), "RECHAZO MODELO OCTUBRE22 NOBANCARIZADO", "x", "RECHAZADO OCTUBRE22 FECHAS"),
    ("Espontaneo", D(2022, 11, 1), "RECHAZO POLITICA NOVIEMBRE22 NB SinInfo", "x", "RECHAZADO NOVIEMBRE22 FECHAS"),
    ("Espontaneo", D(2023, 1, 1), "RECHAZO POLITICA FEBRERO23 EDAD<25", "x", "RECHAZADO FEBRERO23"),
    ("Espontaneo", D(2023, 2, 1), "RECHAZO POLITICA FEBRERO23 EDAD<25", "x", "RECHAZADO        FEBRERO23 FECHAS"),
    ("Espontaneo", D(2023, 2, 1), "APROBADO FEBRERO23", "x", "APROBADO"),
    # codes the roll-up lists do not spell the way the rules do
    ("Espontaneo", D(2023, 2, 1), "RECHAZO MODELO MAYO22 NOBANCARIZADO", "x", "APROBADO"),
    ("Espontaneo", D(2023, 2, 1), "RECHAZO POLITICA MAYO22 NB ConInfo", "x", "RECHAZADO MAYO22"),
    ("Preaprobado", D(2022, 7, 1), "x", "RECHAZO POLITICA AGOSTO22 NBSinPatRet", "RECHAZADO AGOSTO22"),
    ("Preaprobado", D(2022, 8, 1), "x", "RECHAZO POLITICA AGOSTO22 NBSinPatRet", "RECHAZADO AGOSTO22 FECHAS"),
    ("Preaprobado", D(2023, 2, 1), "x", "RECHAZO POLITICA FEBRERO23 EDAD<25", "RECHAZADO FEBRERO23 FECHAS"),
    ("Preaprobado", D(2023, 2, 1), "RECHAZO POLITICA MAYO22 RENTA", "APROBADO FEBRERO23", "APROBADO"),
    ("Otro", D(2023, 2, 1), "x", "x", "OTROS"),
]


def test_roll_up(spark):
    df = frame(spark, "i int, MarcaPreaprobado string, FechaFoto date, CambiosEspontaneo string, CambiosPreaprobadoSinT string, want string", [(i, *r) for i, r in enumerate(ROLL_UP)])
    got = df.select("i", "want", policy.total_changes().alias("got")).orderBy("i").collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


def test_segments(spark):
    df = frame(spark, "b int, p int, r int", [(b, p, r) for b in (0, 1, None) for p in (0, 1) for r in (0, 1)])
    got = {(x.b, x.p, x.r): x.s for x in df.select("*", rules.segment([F.col("b"), F.col("p"), F.col("r")], tracking.BANKED_WEALTH_RETAIL).alias("s")).collect()}
    assert got[(0, 0, 0)] == "NB - SIN PAT - SIN RETAIL" and got[(1, 1, 0)] == "B - CON PAT" and got[(0, 0, 1)] == "NB - CON RETAIL"
    assert got[(1, 1, 1)] == "B - CON PAT - CON RETAIL" and got[(None, 0, 0)] == "Otros"


def test_negative_amounts_fit_no_segment(spark):
    df = frame(spark, "MontoVehiculos double, MontoPropiedad double", [(-1.0, 0.0), (None, 5.0), (3.0, None)])
    expr = rules.segment([tracking.sign_flag("MontoVehiculos"), tracking.sign_flag("MontoPropiedad")], tracking.WEALTH_KIND)
    assert [r.s for r in df.select(expr.alias("s")).collect()] == ["Otros", "Propiedad", "Vehiculo"]
