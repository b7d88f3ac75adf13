"""Fraud marks, the monthly account panel, openings and renegotiation marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import measures
from foliospark.functions.dates import (
    add_months, col, date_lit, is_month_end, month_diff, month_start,
)
from foliospark.functions.scalars import flag, floor_zero, or_zero, prefixed, safe_cast
from foliospark.operators.joins import matched, shift_month, translate_id
from foliospark.operators.rules import category, first_true
from foliospark.operators.sets import cast_like, union_all
from foliospark.operators.skew import hot_lists, previous_row, skew_join
from foliospark.operators.windows import top_n
from foliospark.plans.params import TrackingParams
from foliospark.sources.io import date_range, snapshots

# Layout of the account panel, shared by its two sources
PANEL = [
    ("FechaFoto", "date"), ("Contrato", "string"), ("ContratoAlterno", "string"), ("IdCliente", "bigint"),
    ("SucursalApertura", "string"), ("Cupo", "double"), ("CodigoActividad", "string"),
    ("FechaApertura", "date"), ("FechaNacimiento", "date"), ("DeudaL1", "double"), ("DeudaL2", "double"),
    ("DeudaAvance", "double"), ("DeudaTotal", "double"), ("DiasMora", "bigint"), ("IdSitu", "bigint"),
    ("FechaRenegociacion", "date"), ("FechaUltimoMovimiento", "date"), ("FechaCastigo", "date"),
]
# Employment of each activity code
EMPLOYMENT = {
    "Independiente": [1, 3, 5, 8, 15],
    "Dependiente": [2, 4, 6, 7, 9, 10, 14, 16],
    "Jubilado": [11],
    "Dueña de Casa": [12],
    "Estudiante": [13],
}
# Block descriptions that are not permanent, code of a renegotiation charge, web branch
NOT_PERMANENT = ["Temporal", "Fraude"]
RENEGOTIATION_CODE = 96022
RENEGOTIATION_MOVEMENTS = 10
WEB_BRANCH = "9999"


def client_ids(id_map: DataFrame) -> DataFrame:
    return id_map.select(
        col("id_cliente").cast("bigint").alias("IdCliente"), col("id_corporativo").alias("IdCorporativo")
    )


def fraud_clients(
    feed_a: DataFrame, feed_b: DataFrame, transactions: DataFrame, fraud_transactions: DataFrame,
    ids: DataFrame,
) -> DataFrame:
    """Latest fraud date per client over the three feeds."""
    # a maximum does not change with repeats, so each listed transaction is needed once
    listed = fraud_transactions.select("id_trx").distinct()
    confirmed = matched(transactions.select("id_trx", "cod_contraparte", "fecha_informacion"), listed, ["id_trx"])
    # one date per counterparty before translating its id
    by_counterparty = confirmed.groupBy(col("cod_contraparte").alias("IdCorporativo")).agg(
        F.max(col("fecha_informacion").cast("date")).alias("FechaFraude")
    )
    translated = translate_id(by_counterparty, ids, "IdCorporativo", "IdCliente")
    feeds = union_all(
        feed_a.select(col("rut").alias("IdCliente"), col("fecha_fraude").alias("FechaFraude")),
        feed_b.select(col("id_cliente").alias("IdCliente"), col("fecha_venta").alias("FechaFraude")),
        translated.select("IdCliente", "FechaFraude"),
    )
    # a maximum of maxima is the maximum: one aggregation covers all feeds
    return feeds.groupBy("IdCliente").agg(
        F.max("FechaFraude").alias("FechaFraude"), F.lit(1).alias("MarcaFraude")
    )


def fraud_contracts(contracts: DataFrame) -> DataFrame:
    """Listed contracts as often as they are listed."""
    return contracts.select(prefixed("00", "contrato_final").alias("Contrato"), F.lit(1).alias("MarcaFraude2"))


def panel_rows(old: DataFrame, new: DataFrame, params: TrackingParams = TrackingParams(), buckets: int = 0) -> DataFrame:
    """The old and the new snapshot source in one layout, without repeated rows, and those of an account together.

    Dealt by account once, rows need no further shuffle to drop repeats or to look at the row before, nor to be stored
    in as many ``buckets``.
    """
    opened, born, limit = params.trial_record
    text_date = lambda c: safe_cast(c, "date")
    before = date_range(old, "fecha_foto", params.old_first, params.old_last).select(
        "fecha_foto", "contrato", F.lit("").alias("alterno"), "id_cliente", "centalta", "f_cupo", "coacti",
        text_date("id_dia_aper").alias("aper"), text_date("id_dia_nac").alias("nac"),
        "f_saldeud", "f_salde_su", "f_ava_ocu", "f_saldo", "mora_ac", "id_situ",
        text_date("id_dia_reneg").alias("reneg"), text_date("id_dia_maxultmov").alias("ultmov"),
        col("id_dia_cast").cast("date").alias("castigo"),
    )
    trial = (date_lit(opened), date_lit(born), F.lit(limit))
    real = measures.not_trial(month_start("iddiaaper"), col("iddianac"), col("fcupo"), trial)
    after = snapshots(new, "fechacarga", params.new_snapshots).filter(real).select(
        month_start("fechacarga").alias("mes"), "contrato", "contratoalterno", "idcliente", "centalta",
        "fcupo", "coacti", "iddiaaper", "iddianac", "fsaldeud", "fsaldesu", "favaocu", "fsaldo",
        "moraac", "idsitu", "iddiareneg", "iddiamaxultmov", "iddiacast",
    )
    dealt = ("Contrato",) if not buckets else (buckets, "Contrato")
    return union_all(cast_like(before, PANEL), cast_like(after, PANEL)).repartition(*dealt).distinct()


def account_panel(rows: DataFrame, params: TrackingParams = TrackingParams()) -> DataFrame:
    """Panel rows with the status of the account's previous row. An account has few rows a month: no key is hot."""
    return previous_row(rows, ["Contrato"], "FechaFoto", {"IdSitu_Mmenos1": "IdSitu"})


def permanent_blocks(blocks: DataFrame, params: TrackingParams = TrackingParams()) -> DataFrame:
    kept = date_range(blocks, "fechacarga", first=params.blocks_from).filter(
        ~col("descripcionbloqueo").isin(*NOT_PERMANENT) & is_month_end("fechacarga")
    )
    return kept.select(
        "*", month_start("fechacarga").alias("FechaFoto")
    )


def openings(panel: DataFrame, fraud: DataFrame, blocks: DataFrame, params: TrackingParams = TrackingParams()) -> DataFrame:
    """Accounts opened in the month, or active again after being suspended.

    Runs a job that counts keys of the chosen rows and of the blocks, so the panel should be stored.
    """
    back = (col("IdSitu") == 1) & (col("IdSitu_Mmenos1") == 2)
    opened = month_start("FechaApertura") == col("FechaFoto")
    # the choice needs panel columns only: make it before any join
    chosen = date_range(panel, "FechaFoto", first=params.openings_from).filter(opened | back)
    block = shift_month(
        blocks.select(
            col("contratoalterno").alias("ContratoAlterno"), "FechaFoto",
            col("descripcionbloqueo").alias("DescripcionBloqueo"),
        ),
        "FechaFoto", 1,
    )
    # the old source has one alternate id for all accounts, which makes its months hot here
    blocked = ["ContratoAlterno", "FechaFoto"]
    hot = hot_lists({"client": (chosen, ["IdCliente"]), "alternate": (chosen, blocked), "block": (block, blocked)}, params.skew)
    joined = skew_join(chosen, fraud, ["IdCliente"], hot=hot["client"])
    joined = skew_join(joined, block, blocked, hot=hot["alternate"], right_hot=hot["block"])
    code = or_zero(safe_cast("CodigoActividad", "bigint"))
    use = [
        (floor_zero("DeudaL2") > 0, "Super Avance"),
        (floor_zero("DeudaAvance") > 0, "Avance"),
        (floor_zero("DeudaL1") > 0, "TC"),
    ]
    arrival = measures.arrival(col("IdSitu"), col("IdSitu_Mmenos1"), col("FechaFoto"), col("DescripcionBloqueo"), params.block_needed_from)
    return joined.select(
        "FechaFoto", "IdCliente", "Contrato", "ContratoAlterno", "SucursalApertura", "Cupo", "DeudaTotal",
        "DeudaL1", "DeudaL2", "IdSitu", "DiasMora", "FechaApertura", "FechaNacimiento",
        month_diff("FechaFoto", "FechaNacimiento").alias("EdadMeses"),
        "FechaRenegociacion", "FechaUltimoMovimiento", "CodigoActividad", "DescripcionBloqueo",
        category(code, EMPLOYMENT, "Otros").alias("TipoEmpleo"),
        flag(col("DiasMora") > 0).alias("TieneMora"),
        first_true(use, "Sin deuda").alias("SegmentoUso"),
        flag(col("SucursalApertura") == WEB_BRANCH).alias("AperturaWeb"),
        "FechaFraude", or_zero("MarcaFraude").alias("MarcaFraude"),
        flag(opened).alias("Apertura"),
        arrival.alias("Reapertura"),
    )


def renegotiated(card_events: DataFrame, stock: DataFrame, params: TrackingParams = TrackingParams()) -> DataFrame:
    """Contracts with a renegotiation charge among their first ten movements up to a month after opening.

    An account with several opening rows repeats its events, and the repeats use up ranks.
    Equal opening rows are counted first; more than ten repeats cannot matter to a first ten.
    Only an account's first ten events can matter either: if the eleventh is due under a
    deadline, so are the ten before it. They are chosen first, inside the map tasks.
    """
    first = RENEGOTIATION_MOVEMENTS
    deadlines = (
        stock.groupBy(col("ContratoAlterno").alias("contrato"), add_months("FechaApertura", 1).alias("__limit"))
        .agg(F.least(F.count(F.lit(1)), F.lit(first)).alias("__times"))
    )
    events = card_events.filter(col("fechaoperacion") > date_lit(params.events_after)).select(
        "contrato", "fechaoperacion", "tipofac"
    )
    order = [col("fechaoperacion").asc(), col("tipofac").asc()]
    due = skew_join(
        top_n(events, ["contrato"], order, first), deadlines, ["contrato"], "inner",
        residual=lambda: col("fechaoperacion") <= col("__limit"),
    )
    repeated = due.withColumn("__copy", F.explode(F.sequence(F.lit(1), col("__times").cast("int"))))
    early = top_n(repeated, ["contrato"], order, first)
    return (
        early.filter(col("tipofac") == RENEGOTIATION_CODE)
        .select(col("contrato").alias("Contrato"), F.lit(1).alias("Renegociacion"))
        .distinct()
    )
