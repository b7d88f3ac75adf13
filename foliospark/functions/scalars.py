"""Scalar expressions with the NULL, cast and division behaviour the plans rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.dates import col


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or NULL."""
    return F.when(condition, 1).otherwise(0)


def safe_cast(c: str | Column, to: str) -> Column:
    """NULL where the text cannot be read as ``to`` (``.cast`` raises instead)."""
    return col(c).try_cast(to)


def to_int(c: str | Column) -> Column:
    """Fractional to whole number, halves away from zero (a bare cast would truncate)."""
    return F.round(col(c)).cast("bigint")


def strict_least(*cols: str | Column) -> Column:
    """Smallest argument, NULL as soon as one is NULL (``F.least`` skips NULLs)."""
    cs = [col(c) for c in cols]
    complete = cs[0].isNotNull()
    for c in cs[1:]:
        complete = complete & c.isNotNull()
    return F.when(complete, F.least(*cs))


def floor_zero(c: str | Column) -> Column:
    """NULL and negative amounts count as zero."""
    return F.greatest(or_zero(c), F.lit(0))


def clean_amount(c: str | Column) -> Column:
    """Amount written as text; blank, the word null and NULL count as zero."""
    text = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    return F.when(text.isin("", "null"), F.lit("0")).otherwise(F.coalesce(text, F.lit("0"))).cast("double")


def prefixed(prefix: str, c: str | Column) -> Column:
    return F.concat(F.lit(prefix), col(c))


def ratio_or(numerator: Column, denominator: Column, missing: Column, otherwise: float) -> Column:
    """``numerator / denominator``; ``otherwise`` where ``missing`` holds or the denominator is 0.

    ``try_divide`` only matters to the evaluation of the unused arm: the zero case is
    already routed to ``otherwise``.
    """
    return F.when(missing | (denominator == 0), F.lit(float(otherwise))).otherwise(
        F.try_divide(numerator, denominator)
    )


def nationality_from_letter(c: str | Column) -> Column:
    """Person-registry letter to country number (fixed values: C is 152, all else 999)."""
    return F.when(col(c) == "C", 152).otherwise(999).cast("bigint")


def nationality_from_code(c: str | Column) -> Column:
    """Application-form code to country number (fixed value: CL is 152, else a number as text)."""
    return F.when(col(c) == "CL", F.lit(152).cast("bigint")).otherwise(col(c).cast("bigint"))
