"""Per-entity ordering and trailing-window operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.dates import month_index


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key under ``order``.

    The rank filter sits directly on the window, so Spark trims every map task to ``n``
    rows per key before the shuffle; a hot key never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, keys, order, 1)


def trailing(
    cells: DataFrame,
    keys: Sequence[str],
    month: str,
    months: int,
    sums: dict[str, str],
) -> DataFrame:
    """Adds ``{new: column}`` sums over the last ``months`` calendar months, the row's own included.

    ``cells`` must hold one row per (key, month), as a ``groupBy`` on them leaves it; a
    key then has no more rows than there are months, whatever the raw data looked like.
    """
    w = (
        Window.partitionBy(*keys)
        .orderBy(month_index(month))
        .rangeBetween(-(months - 1), 0)
    )
    return cells.select("*", *[F.sum(F.col(c)).over(w).alias(new) for new, c in sums.items()])
