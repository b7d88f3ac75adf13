"""Limit-increase cohort study: what accounts did after their client's first limit increase.

``limit_changes``, ``first_increase`` and ``increase_follow_up`` are its steps one by one. The study itself gathers each
account's months once into an ordered history, finds the increases in it, and reads the follow-up from the history of
the increase that counts: the snapshots are scanned and dealt by account once, and nothing is joined back to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.dates import month_diff, month_start
from foliospark.functions.scalars import or_zero
from foliospark.operators.joins import follow_up
from foliospark.operators.pivot import pivot_wide
from foliospark.operators.rules import cohort_label, gated_by_offset
from foliospark.operators.sets import union_distinct
from foliospark.operators.skew import previous_row, skew_join
from foliospark.operators.windows import first_per
from foliospark.plans.params import CohortParams
from foliospark.sources.io import snapshots

FIRST_OFFSET, LAST_OFFSET = -1, 10
# Labels of the month offsets
MONTH_LABELS = ["Mmenos1"] + [f"M{k}" for k in range(LAST_OFFSET + 1)]
SUMMED = [
    "FCupoAnterior", "FCupoActual", "MontoAumento", "Porc_Aumento",
    "DeudaL1", "Utilizacion", "DeudaMorosa30", "DeudaTotalL1",
]


def campaign_clients(stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    listed = union_distinct([("IdCliente", "bigint")], stage1.select("rut"), stage2.select("rut"))
    return listed.withColumn("Aumento_Campania", F.lit(1))


def month_panel(account_month: DataFrame, params: CohortParams = CohortParams()) -> DataFrame:
    """Month-end snapshots with their month."""
    return snapshots(account_month, "fechacarga", params.snapshots).select(
        "*", month_start("fechacarga").alias("FechaFoto")
    )


def limit_changes(panel: DataFrame, params: CohortParams = CohortParams()) -> DataFrame:
    rows = panel.select(
        "FechaFoto",
        F.col("contrato").alias("Contrato"),
        F.col("idcliente").alias("IdCliente"),
        F.col("fcupo").alias("FCupoActual"),
    )
    seen = previous_row(rows, ["Contrato"], "FechaFoto", {"FCupoAnterior": "FCupoActual"})
    now, before = F.col("FCupoActual"), F.col("FCupoAnterior")
    return seen.withColumn(
        "CambioCupo", F.when(now > before, "Aumento").when(now < before, "Disminuyo").otherwise("")
    )


def first_increase(changes: DataFrame) -> DataFrame:
    """Each client's earliest increase; two in one month: the lower contract number."""
    increases = changes.filter(F.col("CambioCupo") == "Aumento")
    order = [F.col("FechaFoto").asc(), F.col("Contrato").asc(), F.col("FCupoActual").asc()]
    return first_per(increases, ["IdCliente"], order).select(
        "FechaFoto", "IdCliente", "Contrato", F.lit(1).alias("Aumento"), "FCupoAnterior", "FCupoActual"
    )


def increase_follow_up(
    increases: DataFrame, campaign: DataFrame, panel: DataFrame, params: CohortParams = CohortParams()
) -> DataFrame:
    """One row per increase and month of its account from the month before on."""
    base = increases.withColumnRenamed("FechaFoto", "FechaAumento")
    base = skew_join(base, campaign, ["IdCliente"])
    months = panel.select(
        F.col("contrato").alias("Contrato"), "FechaFoto",
        F.col("fcupo").alias("__limit"), F.col("fsaldeud").alias("__debt"), F.col("moraac").alias("__dpd"),
    )
    return followed_values(follow_up(base, months, "Contrato", "FechaAumento", "FechaFoto", FIRST_OFFSET))


def followed_values(joined: DataFrame) -> DataFrame:
    """The follow-up's columns from increases and the rows of their accounts."""
    joined = joined.withColumn("__k", month_diff("FechaFoto", "FechaAumento"))
    debt = gated_by_offset(F.col("__k"), F.col("__debt"), FIRST_OFFSET, LAST_OFFSET)
    rise = F.col("FCupoActual") - F.col("FCupoAnterior")
    return joined.select(
        "FechaAumento", "FechaFoto", "IdCliente", "Contrato", "FCupoAnterior", "FCupoActual",
        rise.alias("MontoAumento"),
        (F.try_divide(rise, F.col("FCupoAnterior")) * 100).alias("Porc_Aumento"),
        or_zero("Aumento_Campania").alias("Aumento_Campania"),
        cohort_label(F.col("__k"), FIRST_OFFSET, LAST_OFFSET).alias("Mes"),
        debt.alias("DeudaL1"),
        gated_by_offset(F.col("__k"), F.try_divide(F.col("__debt"), F.col("__limit"))).alias("Utilizacion"),
        gated_by_offset(F.col("__k"), F.col("__debt"), also=F.col("__dpd") >= 30).alias("DeudaMorosa30"),
        debt.alias("DeudaTotalL1"),
    )


def account_histories(panel: DataFrame) -> DataFrame:
    """One row per account: its rows in order, as ``previous_row`` orders them. It has no more than there are months."""
    rows = panel.select(
        F.col("contrato").alias("Contrato"), "FechaFoto", F.xxhash64("FechaFoto", "contrato", "idcliente", "fcupo").alias("tie"),
        F.col("idcliente").alias("IdCliente"), F.col("fcupo").alias("limit"), F.col("fsaldeud").alias("debt"), F.col("moraac").alias("dpd"),
    )
    # account by account without a word to the others: a NULL account is one for the order of its rows, but no account
    return rows.groupBy("Contrato").agg(F.sort_array(F.collect_list(F.struct("FechaFoto", "tie", "IdCliente", "limit", "debt", "dpd"))).alias("rows"))


def increases_with_history(histories: DataFrame) -> DataFrame:
    """Each client's earliest increase (see ``first_increase``) with the rows of its account from the month before on."""
    higher = F.expr(
        "filter(transform(sequence(1, greatest(size(rows) - 1, 1)), i -> struct(rows[i].FechaFoto AS FechaFoto, rows[i].IdCliente AS IdCliente, "
        "rows[i].limit AS FCupoActual, rows[i - 1].limit AS FCupoAnterior)), x -> x.FCupoActual > x.FCupoAnterior)"
    )
    found = histories.filter(F.size("rows") > 1).withColumn("found", higher).filter(F.size("found") > 0)
    # of an account only the first increase of each client can count
    first = F.expr("filter(found, (x, i) -> NOT exists(slice(found, 1, i), y -> y.IdCliente <=> x.IdCliente AND y.FechaFoto < x.FechaFoto))")
    one = found.select("Contrato", "rows", F.explode(first).alias("x"))
    known = F.when(F.col("Contrato").isNotNull(), F.expr(f"filter(rows, r -> 12 * (year(r.FechaFoto) - year(x.FechaFoto)) + month(r.FechaFoto) - month(x.FechaFoto) >= {FIRST_OFFSET})"))
    carried = F.struct("x.FechaFoto", "Contrato", "x.FCupoActual", "x.FCupoAnterior", known.alias("rows"))
    return one.groupBy("x.IdCliente").agg(F.min(carried).alias("c")).select("IdCliente", "c.*")


def followed(increases: DataFrame, campaign: DataFrame) -> DataFrame:
    """``increase_follow_up`` from increases that carry their account's rows."""
    base = skew_join(increases.withColumnRenamed("FechaFoto", "FechaAumento"), campaign, ["IdCliente"])
    rows = base.select("*", F.explode_outer("rows").alias("r")).select(
        *[c for c in base.columns if c != "rows"], F.col("r.FechaFoto").alias("FechaFoto"), F.col("r.limit").alias("__limit"), F.col("r.debt").alias("__debt"), F.col("r.dpd").alias("__dpd")
    )
    return followed_values(rows)


def increase_pivot(follow: DataFrame) -> DataFrame:
    return pivot_wide(
        follow, ["FechaAumento", "Aumento_Campania"], "Mes", MONTH_LABELS, "IdCliente", "N", SUMMED
    )


def limit_cohort_report(wide: DataFrame, params: CohortParams = CohortParams()) -> DataFrame:
    """The report of one campaign group, a row per increase month."""
    start = MONTH_LABELS[0]
    columns = [F.col(f"N_{start}").alias("N")]
    for source, name in (
        ("FCupoAnterior", "CupoAnterior"), ("FCupoActual", "CupoActual"),
        ("MontoAumento", "MontoAumento"), ("Porc_Aumento", "Porc_Aumento"),
    ):
        columns.append(F.col(f"{source}_{start}").alias(name))
    columns += [F.col(f"DeudaL1_{m}") for m in MONTH_LABELS]
    columns += [F.col(f"Utilizacion_{m}") for m in MONTH_LABELS]
    for k in range(1, 7):
        columns += [F.col(f"DeudaMorosa30_M{k}"), F.col(f"DeudaTotalL1_M{k}")]
    return (
        wide.filter(F.col("Aumento_Campania") == params.campaign_flag)
        .select("FechaAumento", "Aumento_Campania", *columns)
        .orderBy("FechaAumento")
    )


def limit_cohort(account_month: DataFrame, stage1: DataFrame, stage2: DataFrame, params: CohortParams = CohortParams()) -> DataFrame:
    """The whole study, from the account snapshots and the two campaign lists to the report."""
    # an account has one snapshot a month and a client one first increase: no key is hot
    increases = increases_with_history(account_histories(month_panel(account_month, params)))
    return limit_cohort_report(increase_pivot(followed(increases, campaign_clients(stage1, stage2))), params)
