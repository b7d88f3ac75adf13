"""Ordered rules: band ladders, flag segments, validity choice, policy waterfalls.

Rules are data, folded into one ``CASE`` expression that stays inside code generation.
Literals are Python floats on purpose: a decimal literal would change comparisons.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.dates import col

_COMPARE = {
    "=": operator.eq,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


@dataclass(frozen=True)
class Ladder:
    """Steps ``(comparison, bound, label)`` tried in order; no step true (or NULL): ``otherwise``."""

    steps: tuple[tuple[str, float, str], ...]
    otherwise: str | None = None
    null_label: str | None = None


def first_true(arms: Sequence[tuple[Column, Column | str]], otherwise: Column | str | None) -> Column:
    """The value of the first arm whose condition is true."""
    chain = None
    for condition, value in arms:
        value = F.lit(value) if isinstance(value, str) else value
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    if otherwise is None:
        return chain
    return chain.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


WORD = 63  # rules that one number judges


def first_rules(lists: Mapping[str, Sequence[tuple[Sequence[str], str]]], conditions: Mapping[str, Column], otherwise: str) -> dict[str, Column]:
    """For each list the label of its first rule all of whose conditions are true; a rule is (names of conditions, label).

    All rules are judged at once: each is a bit of a number (lists share one while they fit), a condition that is not true
    clears the bits of the rules that need it, and the lowest bit left of a list is looked up. So a condition is evaluated
    once however many rules name it, and rules add constants to the generated code, not branches.
    """
    words: list[list[str]] = [[]]
    for name, rules in lists.items():
        if len(rules) > WORD:
            raise ValueError(f"{name} has more than {WORD} rules")
        if sum(len(lists[n]) for n in words[-1]) + len(rules) > WORD:
            words.append([])
        words[-1].append(name)
    out = {}
    for names in words:
        every = [rule for name in names for rule in lists[name]]
        left = F.lit((1 << len(every)) - 1).cast("bigint")
        for condition, holds in conditions.items():
            need = sum(1 << k for k, (needed, _) in enumerate(every) if condition in needed)
            if need:
                left = left.bitwiseAND(F.when(holds, F.lit(-1).cast("bigint")).otherwise(F.lit(~need).cast("bigint")))
        first = 0
        for name in names:
            rules = lists[name]
            own = F.shiftright(left, first).bitwiseAND(F.lit((1 << len(rules)) - 1).cast("bigint"))
            labels = F.array(*[F.lit(label) for _, label in rules])
            out[name] = F.when(own == 0, F.lit(otherwise)).otherwise(F.get(labels, F.bit_count(own.bitwiseAND(-own) - 1)))
            first += len(rules)
    return out


def band(value: str | Column, ladder: Ladder) -> Column:
    value = col(value)
    arms = []
    if ladder.null_label is not None:
        arms.append((value.isNull(), ladder.null_label))
    arms += [(_COMPARE[op](value, F.lit(bound)), label) for op, bound, label in ladder.steps]
    return first_true(arms, ladder.otherwise)


def band_by_regime(value: str | Column, changed: Column, before: Ladder, after: Ladder) -> Column:
    """``before`` until ``changed`` becomes true, then ``after``; NULL while ``changed`` is NULL."""
    return F.when(~changed, band(value, before)).when(changed, band(value, after))


def category(value: Column, groups: Mapping[str, Sequence[int]], otherwise: str) -> Column:
    return first_true([(value.isin(*codes), label) for label, codes in groups.items()], otherwise)


def segment(flags: Sequence[Column], labels: Mapping[tuple[int, ...], str], otherwise: str = "Otros") -> Column:
    """Label of a combination of 0/1 flags."""
    arms = []
    for combination, label in labels.items():
        condition = F.lit(True)
        for f, wanted in zip(flags, combination):
            condition = condition & (f == wanted)
        arms.append((condition, label))
    return first_true(arms, otherwise)


def fresh_else(age_days: Column, fresh: Column, fallback: Column, otherwise: Column, missing: Column, limit: int = 60) -> Column:
    """``fresh`` while the record is at most ``limit`` days old, ``fallback`` when older or missing.

    A record whose age cannot be told (not missing, but NULL age) gets ``otherwise``.
    """
    return F.when(age_days <= limit, fresh).when((age_days > limit) | missing, fallback).otherwise(otherwise)


def gated_by_offset(offset: Column, value: Column, first: int = -1, last: int = 10, also: Column | None = None) -> Column:
    """``value`` in the months ``first..last`` of a cohort (and where ``also`` holds), else 0."""
    gate = offset.between(first, last)
    if also is not None:
        gate = gate & also
    return F.when(gate, value).otherwise(0)


def cohort_label(offset: Column, first: int = -1, last: int = 10) -> Column:
    """``Mmenos1, M0 … M10``; anything else is ``M_Otros``."""
    name = F.when(offset < 0, F.concat(F.lit("Mmenos"), (-offset).cast("string"))).otherwise(
        F.concat(F.lit("M"), offset.cast("string"))
    )
    return F.when(offset.between(first, last), name).otherwise("M_Otros")
