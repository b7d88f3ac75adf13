"""Business measures that the tracking plan and the operator queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.dates import date_lit
from foliospark.functions.scalars import or_zero
from foliospark.operators.rules import first_true


def burden(consumer: Column, mortgage: Column, card: Column, advance: Column) -> Column:
    """Monthly load of the debts; an unknown debt weighs nothing."""
    return or_zero(consumer) * 0.035 + or_zero(mortgage) / 240 + or_zero(card) / 6 + or_zero(advance) / 24


def debt_to_income(load: Column, income: Column) -> Column:
    """-1 without an income."""
    return F.when(or_zero(income) > 0, F.try_divide(load, income)).otherwise(-1.0)


def leverage(banked: Column, income: Column, debt: Column) -> Column:
    """Debt per income of banked clients with an income of 300,000 and more, else NULL."""
    return F.when(banked & (income >= 300000), F.try_divide(debt, income))


def pension_income(age: Column, pension: Column) -> Column:
    """The pension-based income if it is at most 45 days old."""
    return F.when((age <= 45) & (pension > 0), pension).otherwise(0)


def evaluated_income(declared: Column, pension: Column) -> Column:
    return F.greatest(or_zero(declared), or_zero(pension))


def delinquent(late: Column, balance: Column) -> Column:
    """The balance of a late account, else 0."""
    return F.when(late, balance).otherwise(0)


def not_trial(opened: Column, born: Column, limit: Column, trial: tuple[Column, Column, Column]) -> Column:
    """Rows that differ from the trial record in any of the three; a comparison with NULL settles nothing."""
    return (opened != trial[0]) | (born != trial[1]) | (limit != trial[2])


def exclusion(situation: Column, fraud: Column, dead: Column) -> Column:
    """Why an account is left out of vintages, the first reason that holds."""
    return first_true(
        [(situation == 2, "03. Suspendido"), (situation == 3, "04. Castigado"), (fraud, "05. Fraude"), (dead, "06. Fallecido")], "Otros"
    )


def arrival(status: Column, before: Column, month: Column, block: Column, block_needed_from: str) -> Column:
    """How an account came: reopened, unblocked (no block on record, where one is needed), or new."""
    back = (status == 1) & (before == 2)
    return first_true(
        [(back & (month < date_lit(block_needed_from)), "Reapertura"), (back & block.isNotNull(), "Reapertura"), (back, "Desbloqueo")], "Originacion"
    )
