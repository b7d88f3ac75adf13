"""The tracking table: openings with every attribute, outcome, band, segment and policy decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import measures
from foliospark.functions.dates import col, day_diff, month_diff
from foliospark.functions.scalars import flag, or_zero, ratio_or
from foliospark.operators.joins import enrich
from foliospark.operators.reduction import KeyFilter, key_filter
from foliospark.operators.rules import band, first_true, fresh_else, segment
from foliospark.operators.skew import crowded, hot_lists, row_numbers, skew_join
from foliospark.plans import accounts, attributes, grouped, ladders, policy
from foliospark.plans.params import TrackingParams
from foliospark.sources.io import co_located, dealt_by, run_folder, store, store_bucketed
from foliospark.sources.published import Version, publish

P = TrackingParams()

# Segment labels
BANKED_WEALTH_RETAIL = {
    (0, 0, 0): "NB - SIN PAT - SIN RETAIL",
    (0, 1, 0): "NB - CON PAT",
    (0, 0, 1): "NB - CON RETAIL",
    (0, 1, 1): "NB - CON PAT - CON RETAIL",
    (1, 0, 0): "B - SIN PAT - SIN RETAIL",
    (1, 1, 0): "B - CON PAT",
    (1, 0, 1): "B - CON RETAIL",
    (1, 1, 1): "B - CON PAT - CON RETAIL",
}
INCOME_WEALTH = {
    (1, 1): "Renta y Patrimonio", (0, 1): "Patrimonio", (1, 0): "Renta", (0, 0): "Sin renta ni patrimonio",
}
WEALTH_KIND = {
    (1, 1): "Propiedad + Vehiculo", (1, 0): "Vehiculo", (0, 1): "Propiedad", (0, 0): "Sin patrimonio",
}


def by_channel(what: str) -> dict[tuple[int, ...], str]:
    return {
        (1, 1): f"{what} - Digital", (1, 0): f"{what} - Presencial",
        (0, 1): f"No {what} - Digital", (0, 0): f"No {what} - Presencial",
    }


def sign_flag(amount: str):
    """1 positive, 0 zero or NULL, NULL negative (a negative amount fits no segment)."""
    value = or_zero(amount)
    return F.when(value > 0, 1).when(value == 0, 0)


def derived(joined: DataFrame) -> DataFrame:
    """Columns computed from an opening and its attributes.

    Names that replace an input (the scores and grades) all read the input: one ``select``.
    """
    age = day_diff("FechaApertura", "FechaSolicitud")
    no_application = col("FechaSolicitud").isNull()

    def fresh(of_application, of_source, otherwise):
        return fresh_else(age, of_application, of_source, otherwise, no_application)

    zero = F.lit(0)
    home, car = or_zero("AvaluoPropiedad"), or_zero("TasacionVehiculo")
    homes, cars = or_zero("AvaluoTotal"), or_zero("TasacionTotal")
    load = measures.burden(col("DeudaConsumo"), col("DeudaHipotecario"), col("DeudaL1"), col("DeudaL2"))
    debt3, line3 = col("DeudaConsumoSumU03M"), col("LineaDisponibleSumU03M")
    retail = or_zero("ComprasSU12M") + or_zero("ComprasFU12M")
    chilean = lambda c: F.when(F.coalesce(col(c), F.lit(-1)) == 152, "Chileno").otherwise("Extranjero")
    preapproved = lambda c: F.when(or_zero(c) == 1, "Preaprobado").otherwise("Espontaneo")
    fraud_age = month_diff("FechaFraude", "FechaFoto")
    dead = month_diff("FechaFoto", "FechaDefuncion") >= 0
    score = F.coalesce("PROB_REEST", "ProbPreaprobados")
    replaced = {
        "RentaPiloto": or_zero("RentaPiloto"),
        "PROB_REEST": score,
        "SegmentoPreaprobados": F.coalesce("SegmentoPreaprobados_Reest", "SegmentoPreaprobados"),
        "ProbPreaprobados": score,
    }
    fraud = ((col("MarcaFraude") == 1) | (col("MarcaFraude2") == 1)) & (fraud_age <= 12)
    policy_group = [
        (col("EdadMeses") < 12 * 25, "Edad <25"),
        (col("RecuentoBancarizadoU06M") >= 6, "Bancarizado U06M"),
        (retail > 0, "NB U06M con info"),
    ]
    new = {
        "SegmentoPreaprobados_Antiguo": col("SegmentoPreaprobados"),
        "ProbPreaprobados_Antiguo": col("ProbPreaprobados"),
        "AntiguedadSolicitud": age,
        "MarcaSolicitudMotorValida": flag(age <= 60),
        "RentaEvaluacion": measures.evaluated_income(col("RentaSolicitud"), col("RentaPrevisionValidaU03M")),
        "MarcaBancarizadoU01M": flag(
            or_zero("DeudaConsumo") + or_zero("LineaDisponible") + or_zero("DeudaComercial") + or_zero("DeudaHipotecario") > 0
        ),
        "MarcaBancarizadoU06M": flag(col("RecuentoBancarizadoU06M") >= 6),
        "RatioDeudaLineaMasDeudaU03M": ratio_or(debt3, line3 + debt3, debt3.isNull(), -1.0),
        "CasosTotal": F.lit(1),
        "CargaFinanciera": load,
        "DTI": measures.debt_to_income(load, col("RentaEstimada")),
        "MontoPropiedad": fresh(home, homes, zero),
        "MontoVehiculos": fresh(car, cars, zero),
        "MontoPatrimonio": fresh(home + car, homes + cars, zero),
        "TenenciaPatrimonio": fresh(flag(home + car > 0), flag(homes + cars > 0), zero),
        "Nacionalidad": fresh(chilean("NacionalidadMotor"), chilean("NacionalidadBuro"), F.lit("Extranjero")),
        "MarcaPreaprobado": fresh(preapproved("MarcaPreaprobadoMotor"), preapproved("MarcaPreaprobadosBase"), F.lit("Espontaneo")),
        "SegmentoAplicaVintage": measures.exclusion(col("IdSitu"), fraud, dead),
        "TenenciaRetailML": flag(retail > 0),
        "SegmentoPoliticas": first_true(policy_group, "NB U06M sin info"),
        "LlamadaMotor": F.when(col("__called").isNull(), "Sin llamada al motor").otherwise("Con llamada al motor"),
        "Fallecidos": F.when(dead, "Fallecido").otherwise("No Fallecido"),
    }
    for days, horizon in ((30, 2), (30, 3), (30, 6), (60, 6), (90, 12)):
        late = col(f"MarcaMora{days}Mes{horizon:02d}") == 1
        new[f"DeudaMorosa{days}Mes{horizon:02d}"] = measures.delinquent(late, col(f"DeudaTotalMes{horizon:02d}"))
        new[f"Casos{days}Mes{horizon:02d}"] = flag(late)
    kept = [c for c in joined.columns if c not in replaced and not c.startswith("__")]
    dropped = {"MarcaFraude2", "SegmentoPreaprobados_Reest"}
    return joined.select(
        *[c for c in kept if c not in dropped], *[e.alias(n) for n, e in replaced.items()], *[e.alias(n) for n, e in new.items()]
    )


CLIENT, CONTRACT = ["IdCliente", "FechaFoto"], ["Contrato", "FechaFoto"]
# the key that each attribute table is joined on; what holds one row per opening comes first, while the openings still
# lie by account, as they are stored
KEYS = {
    "vintage_outcomes": CONTRACT,
    "last_application": CONTRACT,
    "estimated_income": CLIENT,
    "bureau_windows": CLIENT,
    "preapproval_grade": CLIENT,
    "mini_policy": CLIENT,
    "vehicle_wealth": CLIENT,
    "property_wealth": CLIENT,
    "preapproved_base": CLIENT,
    "retail_spend": CLIENT,
    "preapproval_grade_restated": CLIENT,
    "pilot_income": CLIENT,
    "person_latest": ["IdCliente"],
    "provision_pd": CONTRACT,
    "fraud_contracts": ["Contrato"],
}
OF_OPENINGS = ("vintage_outcomes", "last_application")
# tables straight from an input, which may repeat a key; the others are grouped to one row per key
UNGROUPED = (
    "estimated_income", "preapproval_grade", "mini_policy", "preapproved_base", "preapproval_grade_restated",
    "pilot_income", "provision_pd", "fraud_contracts",
)


def stock_hot_keys(stock: DataFrame, params: TrackingParams = P) -> dict[tuple[str, ...], DataFrame | None]:
    """Hot keys of the stored openings. An account opens at most once a month, so its keys need no counting. Runs a job."""
    found = hot_lists({"month": (stock, CLIENT), "client": (stock, ["IdCliente"])}, params.skew)
    return {tuple(CLIENT): found["month"], ("IdCliente",): found["client"]}


def right_hot_keys(tables: dict[str, DataFrame], bureau: DataFrame, params: TrackingParams = P) -> dict[str, DataFrame | None]:
    """Keys that the ungrouped attribute tables repeat very often, and bureau clients with very many rows.

    Runs one job that counts them, and one before it that leaves out tables whose buckets are all small. Tables are those
    that ``build_attributes`` stores.
    """
    asked = {name: (tables[name], KEYS[name]) for name in UNGROUPED} | {"bureau": (bureau, ["IdCliente"])}
    bucketed = set(asked) - {"fraud_contracts"} if bucket_count(bureau, params) else set()
    small = bucketed - crowded({name: asked[name][0] for name in bucketed}, params.skew)
    return dict.fromkeys(asked) | hot_lists({name: what for name, what in asked.items() if name not in small}, params.skew)


def key_filters(
    stock: DataFrame, master: DataFrame, ids: DataFrame, params: TrackingParams = P,
) -> tuple[KeyFilter, KeyFilter, KeyFilter]:
    """Filters of the openings' clients, and of their ids as owners (``client_master``) and in the registry (``client_id_map``).

    Runs a job each; the id lists are reduced to the clients first.
    """
    clients = key_filter(stock, "IdCliente", params.reduction)
    external = [key_filter(clients.reduce(t, "IdCliente"), "IdCorporativo", params.reduction) for t in (master, ids)]
    return clients, external[0], external[1]


def enriched(
    stock: DataFrame, attribute_tables: dict[str, DataFrame],
    hot: dict[tuple[str, ...], DataFrame | None] | None = None,
    right_hot: dict[str, DataFrame | None] | None = None, params: TrackingParams = P,
) -> DataFrame:
    """Reopened and newly opened accounts, not renegotiated, with all attributes.

    ``hot`` and ``right_hot`` name keys with very many rows in the openings and in the attribute tables. Without hot
    openings the narrow base goes to the clients' buckets, where the attributes of clients lie, and the wide one back to
    the accounts' buckets, where theirs lie and repeats are numbered: each moves once.
    """
    t, right_hot = attribute_tables, right_hot or {}
    buckets = bucket_count(stock, params)
    by_client = any((hot or {}).values()) is False and buckets
    base = stock.filter(col("Reapertura").isin("Reapertura", "Originacion"))
    base = skew_join(base, t["renegotiated"], ["Contrato"])
    base = base.filter(or_zero("Renegociacion") == 0).drop("Renegociacion")
    shaped = t | {
        "pilot_income": t["pilot_income"].select(*CLIENT, "RentaPiloto"),
        "vintage_outcomes": t["vintage_outcomes"].drop("IdCliente"),
        "last_application": t["last_application"].withColumnRenamed("IdCliente", "__called"),
    }
    columns = base.columns + [c for name in KEYS for c in shaped[name].columns if c not in KEYS[name]]
    of_accounts = [name for name in KEYS if "Contrato" in KEYS[name]]
    of_clients = [name for name in KEYS if name not in of_accounts]
    for names, key in ((of_clients, "IdCliente"), (of_accounts, "Contrato")):
        base = dealt_by(base, key, buckets if key == "Contrato" or by_client else 0)
        base = enrich(base, [(shaped[name], KEYS[name]) for name in names], hot, [right_hot.get(name) for name in names])
    rows = derived(base.select(*columns))
    # no row is dropped: the number only marks repeats of an account in a month
    order = [("FechaSolicitud", "desc"), ("DescripcionBloqueo", "asc")]
    # a contract that the fraud list repeats very often has as many rows to number
    return row_numbers(rows, CONTRACT, order, "Ranking", hot=right_hot.get("fraud_contracts"), hot_on=["Contrato"])


def segmented(rows: DataFrame) -> DataFrame:
    """Bands, cross segments, leverage and the policy decisions."""
    banked1, banked6 = or_zero("MarcaBancarizadoU01M"), or_zero("MarcaBancarizadoU06M")
    wealth, retail = or_zero("TenenciaPatrimonio"), or_zero("TenenciaRetailML")
    web = col("AperturaWeb")
    income = col("RentaEvaluacion")
    dti = F.when(col("RentaEstimada") == 0, "00. Sin renta").otherwise(band("DTI", ladders.DTI))
    reasons = policy.waterfalls({"spontaneous": policy.SPONTANEOUS, "preapproved": policy.PREAPPROVED})
    new = {
        "ProbPreapFinal": col("ProbPreaprobados"),
        "Leverage": measures.leverage(banked6 == 1, income, col("DeudaConsumo")),
        "SegmentosEvaluar": segment([banked1, wealth, retail], BANKED_WEALTH_RETAIL),
        "SegmentosEvaluarU06M": segment([banked6, wealth, retail], BANKED_WEALTH_RETAIL),
        "TipoSegmentoRetail": segment([retail, web], by_channel("Retail")),
        "TipoSegmentoPatrimonio": segment([wealth, web], by_channel("Patrimonio")),
        "TipoSegmentoBancarizado": segment([banked6, web], by_channel("Bancarizado")),
        "SegmentoCliente": segment([sign_flag("RentaEvaluacion"), col("TenenciaPatrimonio")], INCOME_WEALTH),
        "TipoPatrimonio": segment([sign_flag("MontoVehiculos"), sign_flag("MontoPropiedad")], WEALTH_KIND),
        "TramoDeuda": band(or_zero("DeudaConsumo"), ladders.CONSUMER_DEBT),
        "TramoRatioDeudaLineaMasDeudaU03M": band("RatioDeudaLineaMasDeudaU03M", ladders.DEBT_RATIO),
        "TramoDTI": dti,
        "TramoRentaEvaluacion": band(or_zero("RentaEvaluacion"), ladders.EVALUATED_INCOME),
        "TramoRentaPiloto": band(or_zero("RentaPiloto"), ladders.PILOT_INCOME),
        "TenenciaRentaEvaluacion": flag(or_zero("RentaEvaluacion") > 0),
        "TenenciaRentaPrevisionValida": flag(or_zero("RentaPrevisionU03M") > 0),
        "TramoCupo": band("Cupo", ladders.LIMIT),
        "TramoEdad": band("EdadMeses", ladders.AGE),
        "TramoPatrimonio": band("MontoPatrimonio", ladders.WEALTH),
        "CambiosEspontaneo": reasons["spontaneous"],
        "CambiosPreaprobado": reasons["preapproved"],
        "CambiosPreaprobadoSinT": reasons["preapproved"],
    }
    return rows.select("*", *[e.alias(n) for n, e in new.items()])


def tracking(rows: DataFrame) -> DataFrame:
    return rows.select("*", policy.total_changes().alias("CambiosTotal"))


def bucket_count(stock: DataFrame, params: TrackingParams) -> int:
    return params.buckets if params.buckets is not None else int(stock.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def build_stock(table: Callable[[str], DataFrame], params: TrackingParams = P) -> tuple[DataFrame, DataFrame]:
    """The stored panel and the stored openings; ``table`` returns an input by name. Writes both, and counts keys once.

    Both are stored in buckets by account, so that what is grouped or joined by account later is not shuffled again.
    """
    ids = accounts.client_ids(table("client_id_map"))
    fraud = accounts.fraud_clients(
        table("fraud_clients_a"), table("fraud_clients_b"), table("fin_transactions"),
        table("fraud_transactions"), ids,
    )
    buckets = bucket_count(ids, params)
    # several steps read the panel and all read the openings: each is computed once
    rows = accounts.account_panel(accounts.panel_rows(table("account_month_old"), table("account_month"), params, buckets))
    panel = store_bucketed(rows, "panel", "Contrato", buckets, dealt=True) if buckets else store(rows, "panel")
    blocks = accounts.permanent_blocks(table("contract_blocks"), params)
    opened = accounts.openings(panel, fraud, blocks, params)
    stock = store_bucketed(opened, "openings", "Contrato", buckets) if buckets else store(opened, "openings")
    return panel, stock


def asked_of(stock: DataFrame, params: TrackingParams = P) -> DataFrame:
    """The clients, months and accounts of the openings, stored in buckets by client, as the histories of clients are."""
    asked, buckets = stock.select(*CLIENT, "Contrato").distinct(), bucket_count(stock, params)
    return store_bucketed(asked, "asked", "IdCliente", buckets) if buckets else store(asked, "asked")


def build_attributes(
    table: Callable[[str], DataFrame], panel: DataFrame, stock: DataFrame, params: TrackingParams = P,
    hot: dict[tuple[str, ...], DataFrame | None] | None = None,
) -> tuple[dict[str, DataFrame], dict[str, DataFrame | None]]:
    """The attribute tables by name, and the keys that they repeat very often (one counting job).

    They hold what the openings can join to: histories are reduced to the openings' clients before anything else. Those
    that keys are counted of are stored, in buckets by the key's client or account, so their inputs are derived once and
    neither the counting nor the joins shuffle them.
    """
    a = attributes
    buckets = bucket_count(stock, params)

    def stored(df: DataFrame, name: str, column: str = "IdCliente") -> DataFrame:
        return store_bucketed(df, name, column, buckets) if buckets else store(df, name)

    asked = asked_of(stock, params)
    ids = accounts.client_ids(table("client_id_map"))
    master = a.master_ids(table("client_master"))
    clients, owners, registered = key_filters(stock, master, ids, params)
    of_clients = lambda name, column="id_cliente": clients.reduce(table(name), column)
    tables = {
        "renegotiated": accounts.renegotiated(table("card_events"), stock, params),
        "fraud_contracts": accounts.fraud_contracts(table("fraud_contracts")),
        "estimated_income": stored(a.estimated_income(of_clients("income_logic"), params), "estimated_income"),
        "vintage_outcomes": a.vintage_outcomes(stock, panel, params),
        "preapproval_grade": stored(a.preapproval_grade(of_clients("preapproval_scores"), params), "preapproval_grade"),
        "preapproval_grade_restated": stored(
            a.preapproval_grade_restated(of_clients("preapproval_scores_restated"), params), "preapproval_grade_restated"
        ),
        "mini_policy": stored(a.mini_policy(of_clients("mini_policy", "idcliente"), params), "mini_policy"),
        "vehicle_wealth": stored(
            a.vehicle_wealth(asked, table("vehicles"), master, params, owners, buckets), "vehicle_wealth"
        ),
        "property_wealth": stored(
            a.property_wealth(asked, table("real_estate_month"), table("houses"), master, params, clients, owners, buckets), "property_wealth"
        ),
        "preapproved_base": stored(a.preapproved_base(of_clients("preapproved_base", "idcliente")), "preapproved_base"),
        "person_latest": a.person_latest(table("bureau_person"), ids, params, registered),
        "last_application": a.last_application(asked, table("application_log"), params, (hot or {}).get(tuple(CLIENT)), clients, buckets),
        "retail_spend": stored(
            a.retail_spend(asked, table("retail_spend_s"), table("retail_spend_f"), table("retail_spend_t"), params, clients),
            "retail_spend",
        ),
        "provision_pd": stored(a.provision_pd(table("provision_pd"), params), "provision_pd", "Contrato"),
        "pilot_income": stored(a.pilot_income(of_clients("income_pilot"), params), "pilot_income"),
    }
    bureau = stored(a.bureau_rows(table("bureau_month"), params, clients), "bureau_rows")
    right_hot = right_hot_keys(tables, bureau, params)
    tables["bureau_windows"] = a.bureau_windows(bureau, params, right_hot["bureau"], rows=bureau)
    return tables, right_hot


def build_tracking(table: Callable[[str], DataFrame], params: TrackingParams = P) -> DataFrame:
    """The whole job, from the inputs to the tracking table.

    Building it runs jobs: the panel and the openings are written, the clients of the openings and their external ids are
    listed, and keys are counted three times (chosen rows and blocks, openings, attribute inputs).
    """
    panel, stock = build_stock(table, params)
    hot = stock_hot_keys(stock, params)
    attribute_tables, right_hot = build_attributes(table, panel, stock, params, hot)
    return tracking(segmented(enriched(stock, attribute_tables, hot, right_hot, params)))


def run_tracking(table: Callable[[str], DataFrame], spark: SparkSession, folder: str, params: TrackingParams = P) -> dict[str, str]:
    """Publishes the tracking table and, from it, both reports, each in partitions by month; returns this run's folder of each.

    The tables are ``folder/name`` (``read_published``): readers keep the last version until the new one is whole. What
    the run stores on its way goes to a folder of its own, which is removed at the end.
    """
    base = folder.rstrip("/")

    def written(name: str, version: Version) -> str:
        part = next(iter(version.parts.values()), None)
        return f"{base}/{name}" if part is None else f"{base}/{name}/{part.split('/')[0]}"

    with run_folder(spark), co_located(spark):
        paths = {"tracking": written("tracking", publish(build_tracking(table, params), f"{base}/tracking", grouped.MONTH))}
    for name in grouped.REPORTS:
        paths[name] = written(name, grouped.publish_report(spark, f"{base}/tracking", f"{base}/{name}", name))
    return paths
