"""Monthly histories packed into one row per key, read at offsets from any month.

Flags become bitmaps, a bit a month; amounts become arrays with a place for each month. What was true, seen or owed in
the months after an event then is a shift and a mask, a count of bits, or an element, without a join to the months.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.dates import month_index

WORD = 64  # months of a bitmap word


@dataclass(frozen=True)
class Months:
    """The months that histories cover, both included, as first days."""

    first: dt.date
    last: dt.date

    @property
    def count(self) -> int:
        return 12 * (self.last.year - self.first.year) + self.last.month - self.first.month + 1

    @property
    def words(self) -> int:
        return -(-self.count // WORD)

    def place(self, month: str) -> Column:
        """The number of a month from 0 on; a month outside of them is an error, NULL stays."""
        at = month_index(month) - (12 * self.first.year + self.first.month)
        wrong = F.raise_error(F.concat(F.lit(f"month outside of {self.first} to {self.last}: "), F.col(month).cast("string")))
        return F.when(F.col(month).isNull(), F.lit(None)).when(at.between(0, self.count - 1), at).otherwise(wrong).cast("int")


def packed(df: DataFrame, key: str, month: str, months: Months, flags: Mapping[str, Column], amounts: Mapping[str, Column]) -> DataFrame:
    """One row per key: ``seen`` and each flag as bitmaps (arrays of 64-bit words), each amount as an array by month.

    Rows of one key and month count as one: a flag is set if any sets it, an amount is the largest. Bits and maxima are
    summed up before anything is shuffled, and a key's row has a fixed size.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(month).isNotNull()).select(
        key, months.place(month).alias("__at"), *[f.alias("__f_" + n) for n, f in flags.items()], *[a.alias("__a_" + n) for n, a in amounts.items()]
    )
    bit = "shiftleft(1L, __at % 64)"

    def words(name: str, condition: str) -> list[Column]:
        return [F.coalesce(F.bit_or(F.expr(f"CASE WHEN {condition} AND __at div 64 = {w} THEN {bit} END")), F.lit(0)).alias(f"__{name}_{w}") for w in range(months.words)]

    columns = words("seen", "true")
    for name in flags:
        columns += words("f_" + name, f"__f_{name}")
    for name in amounts:
        columns += [F.max(F.expr(f"CASE WHEN __at = {k} THEN __a_{name} END")).alias(f"__a_{name}_{k}") for k in range(months.count)]
    found = rows.groupBy(key).agg(*columns)
    arrays = [F.array(*[f"__seen_{w}" for w in range(months.words)]).alias("seen")]
    arrays += [F.array(*[f"__f_{n}_{w}" for w in range(months.words)]).alias(n) for n in flags]
    arrays += [F.array(*[f"__a_{n}_{k}" for k in range(months.count)]).alias(n) for n in amounts]
    return found.select(key, *arrays)


def ahead(bitmap: str, at: str, last: int) -> Column:
    """The bits of the months ``at`` to ``at + last`` of a bitmap column, the first one lowest; 0 where it is NULL."""
    if not 0 <= last < WORD:
        raise ValueError("at most 64 months are read at a time")
    mask = (1 << (last + 1)) - 1 if last < WORD - 1 else -1
    low = f"shiftrightunsigned(get({bitmap}, {at} div 64), {at} % 64)"
    high = f"CASE WHEN {at} % 64 > 0 THEN shiftleft(coalesce(get({bitmap}, {at} div 64 + 1), 0L), 64 - {at} % 64) ELSE 0L END"
    return F.expr(f"coalesce(({low} | {high}) & {mask}L, 0L)")


def amount_at(amounts: str, at: str, offset: int) -> Column:
    """The amount ``offset`` months after ``at``; NULL where there is none."""
    return F.expr(f"get({amounts}, {at} + {offset})")
