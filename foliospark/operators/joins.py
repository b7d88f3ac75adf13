"""Joins by month: lagged, as-of, forward horizons, deadlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.dates import add_months, month_diff
from foliospark.operators.skew import skew_join, skew_joins
from foliospark.sources.io import dealt_by


def shift_month(df: DataFrame, month: str, n: int) -> DataFrame:
    """Moves a table ``n`` months forward, so that a lagged join becomes an equal-month join."""
    return df.withColumn(month, add_months(month, n))


def translate_id(df: DataFrame, ids: DataFrame, external: str, internal: str) -> DataFrame:
    """Adds the internal id of an external one; unknown ids stay, with NULL.

    ``df`` must be reduced to few rows per id first (all callers aggregate), so no id is
    hot. Spark broadcasts ``ids`` when its measured size is below the session's limit and
    shuffles both sides otherwise.
    """
    return skew_join(df, ids.select(external, internal), [external], "left")


def matched(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Only the rows with a partner, once per partner (a left join whose partner is not NULL)."""
    return skew_join(df, other, on, "inner")


def asof_within(
    base: DataFrame,
    right: DataFrame,
    key: str,
    month: str,
    value: str,
    months: int | None,
    buckets: int = 0,
) -> DataFrame:
    """For each (key, month) of ``base``: the ``value`` of the latest ``right`` month at or before it.

    ``months`` bounds how far back to look (None: no bound). Among several values of the
    latest month the largest is taken. Pairs without a partner stay, with NULL.

    With ``buckets`` the cells lie by key in so many tasks. No range join: both sides are reduced to one cell per key and month, and a running
    "last seen" walks the cells of a key, of which there are no more than months.
    """
    asked = base.select(
        key, month, F.lit(None).cast(right.schema[value].dataType).alias(value),
        F.lit(True).alias("__asked"), F.lit(False).alias("__known"),
    )
    # a NULL key asks, but never finds anything
    known = right.filter(F.col(key).isNotNull()).select(
        key, month, value, F.lit(False).alias("__asked"), F.lit(True).alias("__known")
    )
    cells = dealt_by(asked, key, buckets).union(dealt_by(known, key, buckets)).groupBy(key, month).agg(
        F.max(value).alias(value), F.max("__asked").alias("__asked"), F.max("__known").alias("__known")
    )
    so_far = Window.partitionBy(key).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("__known"), F.struct(F.col(month).alias("from"), F.col(value).alias("value")))
    found = cells.select(key, month, "__asked", F.last(seen, ignorenulls=True).over(so_far).alias("__seen"))
    reached = F.col("__seen.value")
    if months is not None:
        reached = F.when(month_diff(month, "__seen.from") <= months, reached)
    return found.filter("__asked").select(key, month, reached.alias(value))


def follow_up(
    base: DataFrame,
    panel: DataFrame,
    key: str,
    base_month: str,
    panel_month: str,
    first_offset: int,
) -> DataFrame:
    """``base`` with every panel row of its key from ``first_offset`` months on; unmatched rows stay.

    A key has no more panel rows than there are months, and the base has few rows of a key.
    """
    return skew_join(base, panel, [key], "left", residual=lambda: month_diff(panel_month, base_month) >= first_offset)


def outcome_window(
    base: DataFrame,
    cells: DataFrame,
    keys: Sequence[str],
    key: str,
    month: str,
    horizons: dict[int, dict[str, tuple[str, str]]],
    months_seen: dict[int, str],
) -> DataFrame:
    """Outcomes of each base row over several forward horizons, from one join to the longest.

    ``cells`` holds one row per (``key``, ``month``), and a key enters once a month, so no key is hot. ``horizons[h]`` maps an output name
    to ``(cell column, "at" | "max")``: the value in the month exactly ``h`` later, or the
    largest value in months 0..h; 0 where nothing was seen. ``months_seen[h]`` names the
    number of months seen in 0..h.
    """
    longest = max(horizons)
    entries = base.select(*keys).distinct()
    ahead = cells.withColumnRenamed(month, "__month")
    joined = skew_join(
        entries, ahead, [key], "left",
        residual=lambda: (F.col("__month") >= F.col(month))
        & (F.col("__month") <= add_months(month, longest)),
    )
    aggregates = []
    for h, outputs in horizons.items():
        inside = F.col("__month") <= add_months(month, h)
        exactly = F.col("__month") == add_months(month, h)
        for name, (cell, mode) in outputs.items():
            gate = exactly if mode == "at" else inside
            aggregates.append(F.max(F.when(gate, F.col(cell)).otherwise(0)).alias(name))
        # one cell per month, so counting cells counts distinct months
        aggregates.append(F.count(F.when(inside, F.col("__month"))).alias(months_seen[h]))
    return joined.groupBy(*keys).agg(*aggregates)


def enrich(
    base: DataFrame,
    attributes: Sequence[tuple[DataFrame, Sequence[str]]],
    hot: dict[tuple[str, ...], DataFrame | None] | None = None,
    right_hot: Sequence[DataFrame | None] = (),
) -> DataFrame:
    """``base`` left-joined to every attribute table.

    Tables with the same key are joined one after the other, so the base is shuffled once
    per distinct key rather than once per table. ``hot`` carries the hot keys of the base for
    a key, ``right_hot`` those of each attribute table; what is left out has none.
    """
    groups: dict[tuple[str, ...], list[tuple[DataFrame, DataFrame | None]]] = {}
    for i, (table, on) in enumerate(attributes):
        groups.setdefault(tuple(on), []).append((table, right_hot[i] if i < len(right_hot) else None))
    out = base
    for on, tables in groups.items():
        out = skew_joins(out, [t for t, _ in tables], on, "left", hot=(hot or {}).get(on), right_hot=[h for _, h in tables])
    return out
