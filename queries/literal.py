"""Direct, un-rewritten Spark forms of steps: what the rewritten ones must equal and beat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.dates import add_months, date_lit
from foliospark.functions.scalars import flag, floor_zero
from foliospark.operators.rules import first_true
from foliospark.plans import cohort, policy
from foliospark.plans.attributes import applications

col = F.col
DELINQUENCY = {2: [30], 3: [30], 6: [30, 60], 12: [30, 60, 90]}


def vintage_outcomes(stock: DataFrame, panel: DataFrame) -> DataFrame:
    """One range join per horizon, stacked, then one aggregation over the multiplied rows."""
    out = stock.select("FechaFoto", "IdCliente", "Contrato")
    aggregates = []
    for h, days in DELINQUENCY.items():
        p, s = f"p{h}_", f"Mes{h:02d}"
        months = panel.filter(col("FechaFoto") >= date_lit("2021-01-01")).select(
            *[col(c).alias(p + c) for c in ("FechaFoto", "Contrato", "DeudaL1", "DeudaL2", "DeudaTotal", "DiasMora", "FechaUltimoMovimiento")]
        )
        month = col(p + "FechaFoto")
        reach = (col("Contrato") == col(p + "Contrato")) & (month >= col("FechaFoto")) & (month <= add_months("FechaFoto", h))
        out = out.join(months, reach, "left")
        exactly = add_months("FechaFoto", h) == month
        moved = F.coalesce(col(p + "FechaUltimoMovimiento"), date_lit("1800-01-01")) > date_lit("1800-01-01")
        aggregates += [
            F.max(F.when(exactly, floor_zero(p + "DeudaTotal")).otherwise(0)).alias("DeudaTotal" + s),
            F.max(F.when(exactly, floor_zero(p + "DeudaL1")).otherwise(0)).alias("DeudaL1" + s),
            F.countDistinct(month).alias("MesesConVintage" + s),
            F.max(flag(col(p + "DeudaL2") > 0)).alias("MarcaDeudaSA" + s),
            F.max(flag(moved | (col(p + "DeudaTotal") >= 10000))).alias("RiesgoVivo" + s),
        ]
        aggregates += [F.max(flag(col(p + "DiasMora") >= d)).alias(f"MarcaMora{d}{s}") for d in days]
    return out.groupBy("FechaFoto", "IdCliente", "Contrato").agg(*aggregates)


def limit_cohort(account_month: DataFrame, stage1: DataFrame, stage2: DataFrame, params: cohort.CohortParams) -> DataFrame:
    """The study step by step: the increases are joined back to the snapshots of their accounts."""
    panel = cohort.month_panel(account_month, params)
    increases = cohort.first_increase(cohort.limit_changes(panel, params))
    follow = cohort.increase_follow_up(increases, cohort.campaign_clients(stage1, stage2), panel, params)
    return cohort.limit_cohort_report(cohort.increase_pivot(follow), params)


def bureau_windows(bureau: DataFrame) -> DataFrame:
    """Two range self-joins, each followed by an aggregation over all base columns."""
    names = {"LineaDisponible": "linea_disp", "DeudaConsumo": "dconsumo", "DeudaComercial": "dcomercial", "DeudaHipotecario": "dhipotecar"}
    history = bureau.filter(col("fecha_foto") >= date_lit("2020-06-01")).select(
        col("fecha_foto").alias("h_m"), col("id_cliente").alias("h_c"),
        *[(1000.0 * col(c)).alias("h_" + n) for n, c in names.items()],
        flag(reduce(lambda a, b: a + b, [col(c) for c in names.values()]) > 0).alias("h_banked"),
    )
    base = bureau.filter(col("fecha_foto") >= date_lit("2020-11-01")).select(
        col("fecha_foto").alias("FechaFoto"), col("id_cliente").alias("IdCliente"),
        *[(1000.0 * col(c)).alias(n) for n, c in names.items()],
    )

    def reach(back: int):
        return (
            (col("IdCliente") == col("h_c")) & (col("h_m") <= col("FechaFoto")) & (col("h_m") >= add_months("FechaFoto", -back))
        )

    three = base.join(history, reach(2), "left").groupBy("FechaFoto", "IdCliente", *names).agg(
        *[F.sum("h_" + n).alias(n + "SumU03M") for n in names], *[F.avg("h_" + n).alias(n + "PromU03M") for n in names],
        F.sum(F.when(col("h_c").isNotNull(), 1)).alias("MesesConBuro"),
    )
    six = three.join(history.select("h_m", "h_c", "h_banked"), reach(5), "left").groupBy(*three.columns).agg(
        F.sum("h_banked").alias("RecuentoBancarizadoU06M")
    )
    return six.withColumn("FechaFoto", add_months("FechaFoto", 2))


def renegotiated(card_events: DataFrame, stock: DataFrame) -> DataFrame:
    """Every event once per opening row of its contract, then ranked."""
    s = stock.select(col("ContratoAlterno").alias("s_c"), "FechaApertura")
    due = card_events.filter(col("fechaoperacion") > date_lit("2021-01-01")).join(
        s, (col("contrato") == col("s_c")) & (col("fechaoperacion") <= add_months("FechaApertura", 1))
    )
    w = Window.partitionBy("contrato").orderBy("fechaoperacion", "tipofac")
    ranked = due.withColumn("r", F.row_number().over(w)).filter("r <= 10 AND tipofac = 96022")
    return ranked.select(col("contrato").alias("Contrato"), F.lit(1).alias("Renegociacion")).distinct()


def asof_within(base: DataFrame, right: DataFrame, value: str, months: int) -> DataFrame:
    """Every base row with every value of its client in reach, then the latest."""
    r = right.select(col("IdCliente").alias("r_c"), col("FechaFoto").alias("r_m"), value)
    reach = (col("IdCliente") == col("r_c")) & (col("r_m") <= col("FechaFoto")) & (col("r_m") >= add_months("FechaFoto", -months))
    w = Window.partitionBy("IdCliente", "FechaFoto").orderBy(col("r_m").desc_nulls_last(), col(value).desc_nulls_last())
    joined = base.select("IdCliente", "FechaFoto").distinct().join(r, reach, "left")
    return joined.withColumn("n", F.row_number().over(w)).filter("n = 1").select("IdCliente", "FechaFoto", value)


def last_application(stock: DataFrame, log: DataFrame) -> DataFrame:
    """Every account and month with every application of its client up to it, then the latest."""
    rows = applications(log)
    rows = rows.withColumnsRenamed({"FechaFoto": "a_m", "IdCliente": "a_c"})
    asked = stock.select("IdCliente", "FechaFoto", "Contrato").distinct()
    joined = asked.join(rows, (col("IdCliente") == col("a_c")) & (col("a_m") <= col("FechaFoto")), "left")
    newest = [col("a_m").desc_nulls_last(), col("DRegistro").desc_nulls_last(), col("NumeroSolicitud").desc_nulls_last()]
    first = joined.withColumn("n", F.row_number().over(Window.partitionBy("Contrato", "FechaFoto").orderBy(*newest))).filter("n = 1")
    return first.drop("n", "IdCliente", "FechaFoto").withColumnsRenamed({"a_m": "FechaFoto", "a_c": "IdCliente"})


def waterfall(rules: list[policy.Rule]) -> Column:
    """One arm per rule, its conditions spelled out in it."""
    member, arms = policy.groups(), []
    for rule in rules:
        condition = F.lit(True) if rule.score is None else col(rule.score) > F.lit(rule.above)
        for g in reversed(rule.groups):
            condition = member[g] & condition
        arms.append((condition, rule.code))
    return first_true(arms, policy.APPROVED)


def total_changes() -> Column:
    """One arm per channel and policy, by lists of its codes."""
    arms = []
    for channel, code, rules in (("Espontaneo", "CambiosEspontaneo", policy.SPONTANEOUS), ("Preaprobado", "CambiosPreaprobadoSinT", policy.PREAPPROVED)):
        here = col("MarcaPreaprobado") == channel
        in_force, would_be = [], []
        for month, since in policy.EFFECTIVE[channel].items():
            codes = [r.code for r in rules if r.month == month]
            known = lambda when: col(code).isin(*[x for x in codes if x not in policy.NOT_ROLLED_UP[when]])  # noqa: E731, B023
            label = policy.IN_FORCE_LABEL.get((channel, month), f"RECHAZADO {month} FECHAS")
            in_force.append((here & (col("FechaFoto") >= date_lit(since)) & known("in force"), label))
            would_be.append((here & known("would be"), f"RECHAZADO {month}"))
        arms += [*in_force, *would_be, (here, "APROBADO")]
    return first_true(arms, "OTROS")
