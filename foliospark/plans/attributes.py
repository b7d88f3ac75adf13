"""Monthly attributes attached to the openings, one function per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import measures
from foliospark.functions.dates import (
    add_months, col, date_lit, datetime_text_to_date, month_start, year_diff, year_text_to_date,
)
from foliospark.functions.scalars import (
    clean_amount, flag, floor_zero, nationality_from_code, nationality_from_letter, or_zero, strict_least,
)
from foliospark.operators.history import ahead, amount_at, packed
from foliospark.operators.joins import asof_within, enrich, shift_month, translate_id
from foliospark.operators.reduction import KeyFilter
from foliospark.operators.rules import band, band_by_regime
from foliospark.operators.sets import union_all
from foliospark.operators.skew import crowded, hot_lists, key_id, skew_join
from foliospark.operators.windows import first_per, trailing
from foliospark.plans import ladders
from foliospark.plans.params import TrackingParams
from foliospark.sources.io import date_range, dealt_by, store_bucketed

P = TrackingParams()

# Vehicle types that count as wealth
VEHICLE_TYPES = [
    "AUTOMOVIL", "STATION WAGON", "CAMIONETA", "FURGON", "CAMION", "MAQUINA INDUSTRIAL", "JEEP", "BUS", "MINIBUS",
    "TRACTOR", "TRACTOCAMION", "AMBULANCIA", "MAQUINA AGRICOLA", "CARROBOMBA", "MICROBUS", "OMNIBUS", "TROLEBUS",
]
CLIENT = ["IdCliente", "FechaFoto"]
BUREAU = {
    "LineaDisponible": "linea_disp",
    "DeudaConsumo": "dconsumo",
    "DeudaComercial": "dcomercial",
    "DeudaHipotecario": "dhipotecar",
}


def estimated_income(income: DataFrame, params: TrackingParams = P) -> DataFrame:
    rows = date_range(income, "fecha_foto", first=params.income_from).select(
        col("fecha_foto").alias("FechaFoto"), col("id_cliente").alias("IdCliente"),
        col("renta_final").alias("RentaEstimada"), col("tipo_renta_final").alias("TipoRentaEstimada"),
        col("renta_compras").alias("RentaCompras"), flag(col("renta_compras") > 0).alias("TenenciaRetail"),
    )
    return shift_month(rows, "FechaFoto", 2)


def of_interest(df: DataFrame, column: str, keys: KeyFilter | None) -> DataFrame:
    """The rows whose key an opening can join to, where the keys are known; others may be among them."""
    return df if keys is None else keys.reduce(df, column)


def bureau_rows(bureau: DataFrame, params: TrackingParams = P, clients: KeyFilter | None = None) -> DataFrame:
    return of_interest(date_range(bureau, "fecha_foto", first=params.bureau_history_from), "id_cliente", clients).select(
        col("fecha_foto").alias("FechaFoto"), col("id_cliente").alias("IdCliente"),
        *[(F.lit(1000.0) * col(c)).alias(m) for m, c in BUREAU.items()],
    )


def bureau_windows(
    bureau: DataFrame, params: TrackingParams = P, hot: DataFrame | None | str = "count", clients: KeyFilter | None = None,
    rows: DataFrame | None = None, buckets: int = 0,
) -> DataFrame:
    """Three-month sums and averages and six-month banked count per client and month, two months on; of ``clients`` only, if given.

    Repeated rows weigh as often as they occur, both as the row asked about and as history:
    equal rows are first counted, and the window adds amounts times that count. Clients
    with very many rows (``hot``; counted here if not given) go through one row per month
    instead, so no window grows with them. ``rows``: the bureau rows themselves, where they are stored; in buckets by
    client they need no shuffle. With ``buckets`` they are stored so here, and only counted if a bucket is a large one.
    """
    measures = list(BUREAU)
    rows = bureau_rows(bureau, params, clients) if rows is None else rows
    if buckets:
        rows = store_bucketed(rows, "bureau_rows", "IdCliente", buckets)
        if isinstance(hot, str) and not crowded({"client": rows}, params.skew):
            hot = None
    if isinstance(hot, str):
        hot = hot_lists({"client": (rows, ["IdCliente"])}, params.skew)["client"]
    # every distinct row once, with the number of times it occurs
    distinct = rows.groupBy("FechaFoto", "IdCliente", *measures).agg(F.count(F.lit(1)).alias("__times"))
    banked = flag(sum((col(m) for m in measures[1:]), col(measures[0])) > 0)
    weights = {f"__s_{m}": col(m) * col("__times") for m in measures}
    weights |= {f"__n_{m}": F.when(col(m).isNotNull(), col("__times")).otherwise(0) for m in measures}
    weights |= {"__rows": col("__times"), "__banked": banked * col("__times")}
    weighed = distinct.select("*", *[w.alias(n) for n, w in weights.items()])
    recent = [n for n in weights if n != "__banked"]

    def windows(cells: DataFrame) -> DataFrame:
        out = trailing(cells, ["IdCliente"], "FechaFoto", 3, {"w3" + n: n for n in recent})
        return trailing(out, ["IdCliente"], "FechaFoto", 6, {"w6__banked": "__banked"})

    if hot is None:
        summed = windows(weighed)
    else:
        marked = weighed.withColumn("__id", key_id(weighed, ["IdCliente"])).join(hot, "__id", "left").drop("__id")
        plain = windows(marked.filter("__pieces IS NULL").drop("__pieces"))
        busy = marked.filter("__pieces IS NOT NULL").drop("__pieces")
        cells = busy.groupBy("IdCliente", "FechaFoto").agg(*[F.sum(n).alias(n) for n in weights])
        wide = windows(cells).drop(*weights)
        # Spark splits the rows of a client and month that are many: the other side has one
        split = busy.join(wide.withColumnsRenamed({"IdCliente": "__c", "FechaFoto": "__f"}), col("IdCliente").eqNullSafe(col("__c")) & (col("FechaFoto") == col("__f")), "left").drop("__c", "__f")
        summed = plain.unionByName(split)

    known = col("IdCliente").isNotNull()  # a NULL client matches no history
    times = col("__times")
    out = [add_months("FechaFoto", 2).alias("FechaFoto"), col("IdCliente"), *[col(m) for m in measures]]
    out += [F.when(known, times * col(f"w3__s_{m}")).alias(f"{m}SumU03M") for m in measures]
    out += [
        F.when(known & (col(f"w3__n_{m}") > 0), F.try_divide(col(f"w3__s_{m}"), col(f"w3__n_{m}"))).alias(f"{m}PromU03M")
        for m in measures
    ]
    out.append(F.when(known, times * col("w3__rows")).alias("MesesConBuro"))
    out.append(F.when(known, col("w6__banked")).alias("RecuentoBancarizadoU06M"))
    return date_range(summed, "FechaFoto", first=params.bureau_from).select(*out)


def vintage_outcomes(stock: DataFrame, panel: DataFrame, params: TrackingParams = P) -> DataFrame:
    """Balances, months seen, delinquency and activity 2, 3, 6 and 12 months after opening.

    The panel becomes one packed history per account, and each opening reads its account's at four offsets. On stored
    buckets nothing is shuffled.
    """
    moved = F.coalesce(col("FechaUltimoMovimiento"), date_lit("1800-01-01")) > date_lit("1800-01-01")
    flags = {"l2": col("DeudaL2") > 0, "alive": moved | (col("DeudaTotal") >= 10000)}
    flags |= {f"dpd{d}": col("DiasMora") >= d for d in (30, 60, 90)}
    amounts = {"total": floor_zero("DeudaTotal"), "l1": floor_zero("DeudaL1")}
    months = params.panel_months
    histories = packed(date_range(panel, "FechaFoto", first=params.openings_from), "Contrato", "FechaFoto", months, flags, amounts)
    keys = ["FechaFoto", "IdCliente", "Contrato"]
    # an account has one history and enters once a month: no key is hot
    entries = skew_join(stock.select(*keys).distinct(), histories, ["Contrato"]).withColumn("__at", months.place("FechaFoto"))
    delinquency = {2: [30], 3: [30], 6: [30, 60], 12: [30, 60, 90]}
    out = []
    for h, days in delinquency.items():
        mes = f"Mes{h:02d}"
        seen = lambda bitmap: ahead(bitmap, "__at", h)  # noqa: E731, B023
        out += [F.coalesce(amount_at(a, "__at", h), F.lit(0.0)).alias(n + mes) for a, n in (("total", "DeudaTotal"), ("l1", "DeudaL1"))]
        out.append(F.bit_count(seen("seen")).cast("bigint").alias(f"MesesConVintage{mes}"))
        out += [flag(seen(b) != 0).alias(n + mes) for b, n in (("l2", "MarcaDeudaSA"), ("alive", "RiesgoVivo"))]
        out += [flag(seen(f"dpd{d}") != 0).alias(f"MarcaMora{d}{mes}") for d in days]
    return entries.select(*keys, *out)


def preapproval_grade(scores: DataFrame, params: TrackingParams = P) -> DataFrame:
    prob = col("prob_preaprobados")
    new_regime = col("fecha_foto") >= date_lit(params.scores_regime)
    return date_range(scores, "fecha_foto", first=params.scores_from).select(
        add_months("fecha_foto", 2).alias("FechaFoto"), col("fecha_foto").alias("FechaCortePreaprobados"),
        col("id_cliente").alias("IdCliente"), col("segmento").alias("ClasificacionPreaprobados"),
        prob.alias("ProbPreaprobados"), band(prob, ladders.PROBABILITY).alias("TramoProbabilidadPreap"),
        band_by_regime(prob, new_regime, ladders.GRADE_BEFORE, ladders.GRADE).alias("SegmentoPreaprobados"),
    )


def preapproval_grade_restated(scores: DataFrame, params: TrackingParams = P) -> DataFrame:
    return date_range(scores, "fecha_foto", first=params.restated_from).select(
        add_months("fecha_foto", 2).alias("FechaFoto"), col("id_cliente").alias("IdCliente"),
        col("prob").alias("PROB_REEST"), band("prob", ladders.GRADE).alias("SegmentoPreaprobados_Reest"),
    )


def mini_policy(checks: DataFrame, params: TrackingParams = P) -> DataFrame:
    parts = {
        "CumpleMinipoliticaBanco": "cumpleminipoliticabanco",
        "CumpleMinipoliticaTarjeta": "cumpleminipoliticatarjeta",
        "CumpleMinipoliticaComercial": "cumpleminipoliticacomercial",
        "CumpleMinipoliticaBuro": "cumpleminipoliticaburo",
    }
    return date_range(checks, "fechafoto", first=params.policy_from).select(
        add_months("fechafoto", 1).alias("FechaFoto"), col("idcliente").alias("IdCliente"),
        *[col(c).alias(n) for n, c in parts.items()],
        strict_least(*parts.values()).alias("CumpleMinipolitica"),
    )


def master_ids(client_master: DataFrame) -> DataFrame:
    return client_master.select(
        col("idcorporativo").alias("IdCorporativo"), col("idcliente").cast("bigint").alias("IdCliente")
    )


def appraised(rows: DataFrame, params: TrackingParams) -> DataFrame:
    """Appraisals that an opening can look back to: a filter on the stored column, so that it reaches the scan."""
    return date_range(rows, "upload_dt", first=params.wealth_from, before=params.wealth_before)


def vehicle_totals(
    vehicles: DataFrame, master: DataFrame, params: TrackingParams = P, owners: KeyFilter | None = None, buckets: int = 0,
) -> DataFrame:
    """Appraised value of the vehicles up to 15 years old, per client and month; of ``owners`` only, if given."""
    rows = of_interest(appraised(vehicles, params), "num_rut", owners).select(
        col("num_rut").alias("IdCorporativo"), month_start("upload_dt").alias("FechaFoto"),
        clean_amount("vr_appraised_amt").alias("TasacionTotal"), "vr_type", year_text_to_date("vr_year").alias("__made"),
    ).filter(
        (year_diff("FechaFoto", "__made") <= 15) & col("vr_type").isin(*VEHICLE_TYPES)
    )
    # summed per owner before the ids are translated: fewer rows to join, same totals
    summed = rows.groupBy("IdCorporativo", "FechaFoto").agg(F.sum("TasacionTotal").alias("TasacionTotal"))
    owned = dealt_by(translate_id(summed, master, "IdCorporativo", "IdCliente"), "IdCliente", buckets)
    return owned.groupBy("IdCliente", "FechaFoto").agg(F.sum("TasacionTotal").alias("TasacionTotal"))


def vehicle_wealth(
    stock: DataFrame, vehicles: DataFrame, master: DataFrame, params: TrackingParams = P, owners: KeyFilter | None = None, buckets: int = 0,
) -> DataFrame:
    totals = vehicle_totals(vehicles, master, params, owners, buckets)
    return asof_within(stock, totals, "IdCliente", "FechaFoto", "TasacionTotal", 12, buckets)


def property_totals(
    real_estate: DataFrame, houses: DataFrame, master: DataFrame, params: TrackingParams = P,
    clients: KeyFilter | None = None, owners: KeyFilter | None = None, buckets: int = 0,
) -> DataFrame:
    """Property value per client and month: one row per feed that reports the month; of ``clients`` and ``owners`` only, if given."""
    estates = of_interest(
        date_range(real_estate, "fecha_foto", first=params.real_estate_from, before=params.wealth_before), "id_cliente", clients
    ).groupBy(col("id_cliente").alias("IdCliente"), month_start("fecha_foto").alias("FechaFoto")).agg(
        F.sum(col("avaluo_total").cast("bigint")).alias("AvaluoTotal")
    )
    rows = of_interest(appraised(houses, params), "nhr_owner_rut_id", owners).select(
        col("nhr_owner_rut_id").alias("IdCorporativo"), month_start("upload_dt").alias("FechaFoto"),
        col("nhr_prop_val_amt").cast("bigint").alias("AvaluoTotal"),
    )
    summed = rows.groupBy("IdCorporativo", "FechaFoto").agg(
        F.sum("AvaluoTotal").alias("AvaluoTotal")
    )
    owned = dealt_by(translate_id(summed, master, "IdCorporativo", "IdCliente"), "IdCliente", buckets)
    homes = owned.groupBy("IdCliente", "FechaFoto").agg(F.sum("AvaluoTotal").alias("AvaluoTotal"))
    return union_all(estates, homes)


def property_wealth(
    stock: DataFrame, real_estate: DataFrame, houses: DataFrame, master: DataFrame, params: TrackingParams = P,
    clients: KeyFilter | None = None, owners: KeyFilter | None = None, buckets: int = 0,
) -> DataFrame:
    totals = property_totals(real_estate, houses, master, params, clients, owners, buckets)
    return asof_within(stock, totals, "IdCliente", "FechaFoto", "AvaluoTotal", 12, buckets)


def preapproved_base(base: DataFrame) -> DataFrame:
    return base.select(
        col("idcliente").alias("IdCliente"), col("fechafoto").alias("FechaFoto"),
        col("marcapreaprobadosbase").alias("MarcaPreaprobadosBase"),
    )


def person_latest(persons: DataFrame, ids: DataFrame, params: TrackingParams = P, registered: KeyFilter | None = None) -> DataFrame:
    """Latest registry record of each client; of the ``registered`` ids only, if given."""
    rows = of_interest(date_range(persons, "fechacarga", first=params.person_from), "idcliente", registered).select(
        col("idcliente").alias("IdCorporativo"), col("fechanacimiento").alias("FechaNacimientoBuro"),
        nationality_from_letter("nacionalidad").alias("NacionalidadBuro"),
        col("fechadefuncion").alias("FechaDefuncion"), col("fechacarga").alias("__loaded"),
    )
    newest = lambda c: col(c).desc_nulls_last()
    order = [newest("__loaded"), newest("FechaNacimientoBuro"), newest("FechaDefuncion"), newest("NacionalidadBuro")]
    # the newest record per registry id, then per client: same winner, little to translate
    newest_each = first_per(rows, ["IdCorporativo"], order)
    owned = translate_id(newest_each, ids, "IdCorporativo", "IdCliente")
    return first_per(owned, ["IdCliente"], order).drop("__loaded", "IdCorporativo")


def _applied(log: DataFrame, params: TrackingParams) -> DataFrame:
    return date_range(log, "fechacarga", first=params.applications_from).filter(col("norigen") == 2)


def applications(log: DataFrame, params: TrackingParams = P) -> DataFrame:
    """Applications of the card origin, with cleaned income and appraisals."""
    rows = _applied(log, params)
    applied = datetime_text_to_date("dregistro")
    declared = or_zero(col("niaprenta").cast("bigint"))
    pension = col("rentpromprev")
    return rows.select(
        month_start(applied).alias("FechaFoto"), applied.alias("FechaSolicitud"), col("dregistro").alias("DRegistro"),
        col("idcliente").alias("IdCliente"), col("nsolic").alias("NumeroSolicitud"), col("niacpreaprobado").alias("CodigoPreaprobado"),
        or_zero(col("aiafpreaprobado").cast("bigint")).alias("MarcaPreaprobadoMotor"),
        col("aaevaleafnodename").alias("NodoEvaluacion"), col("arsltdpolcategoria").alias("CategoriaPolitica"),
        F.when(col("niasosolicsucapert") == "9999", "Web").otherwise("Presencial").alias("CanalMotor"),
        col("aiprevmfirmaautoprev").alias("AutorizaPrevision"), col("diaccocfecrenta").alias("FechaRentaSolicitud"),
        F.when((col("ctiposolic") == "EVA") & (declared > 0), declared).otherwise(0).alias("RentaSolicitud"),
        pension.alias("RentaPrevisionU03M"),
        measures.pension_income(col("antprevision"), pension).alias("RentaPrevisionValidaU03M"),
        col("antprevision").alias("AntiguedadPrevision"), col("numcotival").alias("NumeroCotizacionesU03M"),
        col("aexctacastigada").alias("MarcaExCastigada"),
        col("niapavaluopropiedad").cast("bigint").alias("AvaluoPropiedad"),
        col("niaptasacionvehiculo").cast("bigint").alias("TasacionVehiculo"),
        col("niapaniovehiculo").cast("bigint").alias("AgnoVehiculo"),
        col("iantecedentesdelasolicitudai").alias("ClasificacionApertura"),
        nationality_from_code("anacionalidad").alias("NacionalidadMotor"),
    )


def last_application(
    stock: DataFrame, log: DataFrame, params: TrackingParams = P, hot: DataFrame | None = None, clients: KeyFilter | None = None,
    buckets: int = 0,
) -> DataFrame:
    """For each account and month its client's latest application up to that month.

    ``FechaFoto`` and ``IdCliente`` are those of the application (NULL without one). ``hot``: clients and months with
    very many accounts. An application is carried whole, with what orders it first, so that the newest of a month is a
    maximum and the newest up to a month is the last one seen: one window over cells of client and month, and no join back.
    """
    rows = applications(of_interest(log, "idcliente", clients), params)
    order = ["DRegistro", "NumeroSolicitud"]
    carried = F.struct(*order, *[c for c in rows.columns if c not in order])
    known = rows.filter(col("IdCliente").isNotNull() & col("FechaFoto").isNotNull()).select(*CLIENT, carried.alias("__seen"), F.lit(False).alias("__asked"))
    asked = stock.select(*CLIENT, F.lit(None).cast(known.schema["__seen"].dataType).alias("__seen"), F.lit(True).alias("__asked"))
    cells = dealt_by(known, "IdCliente", buckets).union(dealt_by(asked, "IdCliente", buckets)).groupBy(*CLIENT).agg(F.max("__seen").alias("__seen"), F.max("__asked").alias("__asked"))
    so_far = Window.partitionBy("IdCliente").orderBy("FechaFoto").rowsBetween(Window.unboundedPreceding, 0)
    found = cells.select(*CLIENT, "__asked", F.last("__seen", ignorenulls=True).over(so_far).alias("__seen"))
    found = found.filter(col("__asked") & col("__seen").isNotNull()).drop("__asked")
    of_account = skew_join(stock.select(*CLIENT, "Contrato").distinct(), found, CLIENT, hot=hot)
    # an account has few clients in a month; the newest application of them counts
    one = dealt_by(of_account, "Contrato", buckets).groupBy("Contrato", "FechaFoto").agg(F.max("__seen").alias("__seen"))
    return one.select("Contrato", *[col("__seen")[c].alias(c) for c in rows.columns])


def retail_spend(
    stock: DataFrame, spend_s: DataFrame, spend_f: DataFrame, spend_t: DataFrame, params: TrackingParams = P, clients: KeyFilter | None = None,
) -> DataFrame:
    """Twelve-month spend at the three retailers, as of the month before."""
    base = stock.select("FechaFoto", "IdCliente").distinct()
    tables = []
    for letter, table in (("s", spend_s), ("f", spend_f), ("t", spend_t)):
        rows = of_interest(date_range(table, "fecha_foto", first=params.retail_from), "id_cliente", clients).select(
            col("fecha_foto").alias("FechaFoto"), col("id_cliente").alias("IdCliente"),
            col(f"monto_{letter}_12m").alias(f"__{letter}"),
        )
        tables.append((shift_month(rows, "FechaFoto", 1), ["IdCliente", "FechaFoto"]))
    # the base has one row per pair, so no pair can be hot
    joined = enrich(base, tables)
    amounts = {f"Compras{letter.upper()}U12M": or_zero(f"__{letter}") for letter in "sft"}
    return joined.select(
        "FechaFoto", "IdCliente", *[a.alias(n) for n, a in amounts.items()],
        *[flag(a > 0).alias(n.replace("Compras", "Tenencia")) for n, a in amounts.items()],
    )


def provision_pd(provisions: DataFrame, params: TrackingParams = P) -> DataFrame:
    return date_range(provisions, "fechacarga", first=params.provision_from).select(
        col("fechacarga").alias("FechaFoto"), col("ctacontrato").alias("Contrato"),
        col("pdfinal").alias("Pd_Provisiones"), band("pdfinal", ladders.PROBABILITY).alias("TramoPdProvisiones"),
    )


def pilot_income(pilot: DataFrame, params: TrackingParams = P) -> DataFrame:
    return date_range(pilot, "fecha_foto", first=params.pilot_from).select(
        add_months("fecha_foto", 2).alias("FechaFoto"), col("id_cliente").alias("IdCliente"),
        col("renta_modelo").alias("Renta"), col("flag_con_info").alias("Flag"), col("renta_piloto").alias("RentaPiloto"),
    )
