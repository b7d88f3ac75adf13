"""Pivot with several aggregates and a fixed list of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_wide(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    labels: Sequence[str],
    count_of: str,
    count_name: str,
    sums: Sequence[str],
) -> DataFrame:
    """One row per key with ``<aggregate>_<label>`` columns.

    The labels are given, so Spark runs no extra job to find them. A label without rows
    has count 0 and NULL sums.
    """
    aggregates = [F.count(count_of).alias(count_name)] + [F.sum(c).alias(c) for c in sums]
    wide = df.groupBy(*keys).pivot(label, list(labels)).agg(*aggregates)
    out = [F.col(k) for k in keys]
    for m in labels:
        out.append(F.coalesce(F.col(f"{m}_{count_name}"), F.lit(0)).alias(f"{count_name}_{m}"))
        out += [F.col(f"{m}_{c}").alias(f"{c}_{m}") for c in sums]
    return wide.select(*out)
