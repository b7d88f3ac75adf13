"""Portfolio reports: counts and sums of the tracking table by segment.

Both have the month among their keys, so a month of a report follows from that month of the tracking table alone. A
report is published in partitions by month and remembers the folder of the tracking table that each was made from;
``refresh_report`` reads and aggregates only months whose folder is another one by now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.published import Version, current, publish, publish_partitions, read_published

MONTH = "FechaFoto"

# Segment columns and summed columns of the reports
KEYS = [
    "FechaFoto", "TipoEmpleo", "TenenciaRetailML", "TramoProbabilidadPreap", "SegmentoPreaprobados",
    "TramoPdProvisiones", "MarcaPreaprobado", "TramoRentaEvaluacion", "TramoEdad", "TipoSegmentoBancarizado",
    "SegmentoAplicaVintage", "TramoCupo", "TramoPatrimonio",
]
SUMS = [
    "DeudaTotalMes03", "DeudaTotalMes06", "ProbPreapFinal", "Pd_Provisiones", "Leverage", "Cupo",
    "DeudaMorosa30Mes03", "DeudaMorosa30Mes06", "DeudaMorosa60Mes06",
]


def _roll_up(tracking: DataFrame, keys: list[str]) -> DataFrame:
    return tracking.groupBy(*keys).agg(F.count("Contrato").alias("N"), *[F.sum(c).alias(c) for c in SUMS])


def portfolio_grouped(tracking: DataFrame) -> DataFrame:
    return _roll_up(tracking, KEYS)


def portfolio_grouped_changes(tracking: DataFrame) -> DataFrame:
    return _roll_up(tracking, [*KEYS, "CambiosTotal"])


REPORTS = {"portfolio_grouped": portfolio_grouped, "portfolio_grouped_changes": portfolio_grouped_changes}


def publish_report(spark: SparkSession, tracking_path: str, report_path: str, name: str) -> Version:
    """Builds a whole report from the newest version of the tracking table and replaces the old one."""
    made_from = current(spark, tracking_path)
    if made_from is None:
        raise FileNotFoundError(f"{tracking_path} has no version")
    rows = read_published(spark, tracking_path, made_from.number)
    return publish(REPORTS[name](rows), report_path, MONTH, source=made_from.parts)


def refresh_report(spark: SparkSession, tracking_path: str, report_path: str, name: str) -> list[str]:
    """Brings a report up to date with the tracking table; returns the months that were aggregated again or taken away."""
    made_from, report = current(spark, tracking_path), current(spark, report_path)
    if report is None:
        publish_report(spark, tracking_path, report_path, name)
        return sorted(made_from.parts) if made_from else []
    now = made_from.parts if made_from else {}
    changed = [month for month, folder in now.items() if report.source.get(month) != folder]
    stale = sorted({*changed, *[month for month in report.source if month not in now]})
    if stale:
        rows = read_published(spark, tracking_path, made_from.number, only=changed)
        source = {month: now[month] for month in changed}
        publish_partitions(REPORTS[name](rows), report_path, MONTH, emptied=stale, source=source, based_on=report.number)
    return stale
