"""Unions of sources whose declared types may differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cast_like(df: DataFrame, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """Names and types of ``schema``, by position."""
    return df.select(*[F.col(c).cast(t).alias(n) for c, (n, t) in zip(df.columns, schema, strict=True)])


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def union_distinct(schema: Sequence[tuple[str, str]], *parts: DataFrame) -> DataFrame:
    """Positional union without duplicate rows.

    ``distinct`` combines copies inside each task before its shuffle and spreads the rest
    by the hash of the whole row, so a much-copied row does not load one task.
    """
    return union_all(*[cast_like(p, schema) for p in parts]).distinct()
