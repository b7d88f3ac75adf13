"""Credit-policy back-test: which successive policy would have rejected an account, and why.

A policy is a list of rules tried in order. A rule applies to the accounts in all of its
groups and rejects them when the named score is above the threshold (no score: always).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.dates import col, date_lit
from foliospark.functions.scalars import or_zero
from foliospark.operators.rules import first_rules

OLD, NEW = "ProbPreaprobados_Antiguo", "ProbPreaprobados"
APPROVED = "APROBADO FEBRERO23"


@dataclass(frozen=True)
class Rule:
    month: str
    kind: str
    tag: str
    groups: tuple[str, ...] = ()
    score: str | None = None
    above: float | None = None

    @property
    def code(self) -> str:
        return f"RECHAZO {self.kind} {self.month} {self.tag}"


def _rules(month: str, kind: str, *rows: tuple) -> list[Rule]:
    return [Rule(month, kind, tag, tuple(groups.split()), score, above) for tag, groups, score, above in rows]


# Rules of every policy, in the order they are tried
FEBRUARY = _rules(
    "FEBRERO23", "POLITICA",
    ("NB SinInfo Extranjero", "banked no_info foreign", None, None),
    ("NB SinInfo Chileno", "banked no_info chilean", NEW, 0.09),
    ("EDAD<25", "under_25", NEW, 0.09),
    ("EDAD<25 SinInfo Extranjero", "under_25 no_info foreign", NEW, 0.07),
)

SPONTANEOUS = (
    _rules(
        "MAYO22", "POLITICA",
        ("PD>0.25", "", OLD, 0.25),
        ("RENTA", "low_income", None, None),
        ("DUEÑA DE CASA", "homemaker", None, None),
        ("EDAD<21", "under_21", None, None),
        ("EDAD<25", "under_25", OLD, 0.15),
        ("BANCARIZADO", "banked", OLD, 0.25),
        ("NB ConInfo", "unbanked", OLD, 0.25),
        ("NB SinInfo", "unbanked no_info", OLD, 0.25),
    )
    + _rules(
        "MAYO22", "MODELO",
        ("BANCARIZADO", "model_banked", OLD, 0.25),
        ("NOBANCARIZADO", "model_unbanked", OLD, 0.25),
        ("EXTRANJERO NB", "model_foreign", OLD, 0.25),
        ("MENOR 21", "model_under_21", None, None),
    )
    + _rules(
        "OCTUBRE22", "POLITICA",
        ("EDAD<25", "under_25", NEW, 0.10),
        ("BANCARIZADO", "banked", NEW, 0.13),
        ("NB ConInfo", "unbanked some_holding", NEW, 0.13),
        ("NB SinInfo", "unbanked no_info", NEW, 0.10),
    )
    + _rules(
        "OCTUBRE22", "MODELO",
        ("BANCARIZADO", "model_banked", NEW, 0.13),
        ("NOBANCARIZADO", "model_unbanked", NEW, 0.10),
        ("EXTRANJERO NB", "model_foreign", NEW, 0.10),
    )
    + _rules(
        "NOVIEMBRE22", "POLITICA",
        ("BANCARIZADO", "banked", NEW, 0.12),
        ("NB ConInfo", "unbanked", NEW, 0.12),
        ("NB SinInfo", "unbanked no_info", NEW, 0.09),
    )
    + _rules(
        "NOVIEMBRE22", "MODELO",
        ("BANCARIZADO", "model_banked", NEW, 0.12),
        ("NOBANCARIZADO", "model_unbanked", NEW, 0.10),
        ("EXTRANJERO NB", "model_foreign", NEW, 0.10),
    )
    + FEBRUARY
)

PREAPPROVED = (
    _rules(
        "AGOSTO22", "POLITICA",
        ("EDAD<25", "under_25", OLD, 0.15),
        ("Bancarizado", "banked", OLD, 0.20),
        ("NBConPatRet", "unbanked some_holding", OLD, 0.20),
        ("NBSinPatRet", "unbanked no_holding", OLD, 0.16),
    )
    + _rules(
        "OCTUBRE22", "POLITICA",
        ("EDAD<25", "under_25", NEW, 0.11),
        ("BANCARIZADO", "banked", NEW, 0.13),
        ("NB ConInfo", "unbanked", NEW, 0.13),
        ("NB SinInfo", "unbanked no_info", NEW, 0.10),
    )
    + _rules(
        "OCTUBRE22", "MODELO",
        ("BANCARIZADO", "model_banked", NEW, 0.13),
        ("NOBANCARIZADO", "model_unbanked", NEW, 0.13),
        ("EXTRANJERO NB", "model_foreign", NEW, 0.13),
        ("EDAD<21", "model_under_21", NEW, 0.09),
    )
    + _rules(
        "NOVIEMBRE22", "POLITICA",
        ("EDAD<25", "under_25", NEW, 0.10),
        ("BANCARIZADO", "banked", NEW, 0.12),
        ("NB ConInfo", "unbanked some_holding", NEW, 0.12),
        ("NB SinInfo", "unbanked no_info", NEW, 0.09),
    )
    + _rules(
        "NOVIEMBRE22", "MODELO",
        ("BANCARIZADO", "model_banked", NEW, 0.12),
        ("NOBANCARIZADO", "model_unbanked", NEW, 0.12),
        ("EXTRANJERO NB", "model_foreign", NEW, 0.12),
        ("EDAD<21", "model_under_21", NEW, 0.08),
    )
    + FEBRUARY
)

# When each policy took effect
EFFECTIVE = {
    "Espontaneo": {
        "MAYO22": "2022-05-01", "OCTUBRE22": "2022-10-01", "NOVIEMBRE22": "2022-11-01", "FEBRERO23": "2023-02-01",
    },
    "Preaprobado": {
        "AGOSTO22": "2022-08-01", "OCTUBRE22": "2022-10-01", "NOVIEMBRE22": "2022-11-01", "FEBRERO23": "2023-02-01",
    },
}
# Reason codes the roll-up does not know. No account gets them: the first
# rule takes every account they could apply to.
NOT_ROLLED_UP = {
    "in force": {"RECHAZO POLITICA MAYO22 NB ConInfo", "RECHAZO MODELO MAYO22 NOBANCARIZADO"},
    "would be": {"RECHAZO MODELO MAYO22 NOBANCARIZADO"},
}
# One in-force label is written with a run of spaces
IN_FORCE_LABEL = {("Espontaneo", "FEBRERO23"): "RECHAZADO        FEBRERO23 FECHAS"}


def groups() -> dict[str, Column]:
    """Membership of each account group a rule can name."""
    banked = or_zero("MarcaBancarizadoU06M")
    income = or_zero("RentaEvaluacion")
    spend = or_zero("ComprasSU12M") + or_zero("ComprasFU12M")
    wealth, retail = col("TenenciaPatrimonio"), col("TenenciaRetailML")
    model = col("ClasificacionPreaprobados")
    return {
        "banked": banked == 1,
        "unbanked": banked == 0,
        "no_info": (or_zero(wealth) == 0) & (spend == 0),
        "some_holding": (wealth > 0) | (retail > 0),
        "no_holding": (or_zero(wealth) == 0) & (or_zero(retail) == 0),
        "low_income": (income > 0) & (income < 400000),
        "homemaker": col("TipoEmpleo") == "Dueña de Casa",
        "under_21": col("EdadMeses") < 21 * 12,
        "under_25": col("EdadMeses") < 25 * 12,
        "foreign": col("Nacionalidad") == "Extranjero",
        "chilean": col("Nacionalidad") == "Chileno",
        "model_banked": model == "BANCARIZADO MAYOR 21",
        "model_unbanked": model == "NO BANCARIZADO MAYOR 21",
        "model_foreign": model == "EXTRANJERO NO BANCARIZADO",
        "model_under_21": model == "MENOR 21",
    }


def waterfalls(lists: Mapping[str, Sequence[Rule]], member: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """For each list of rules the reason code of the first rule that rejects the account."""
    member = groups() if member is None else member
    above = {(r.score, r.above) for rules in lists.values() for r in rules if r.score is not None}
    conditions = {**member, **{f"{score} > {bound}": col(score) > F.lit(bound) for score, bound in sorted(above)}}
    named = {
        name: [((*rule.groups, *([f"{rule.score} > {rule.above}"] if rule.score is not None else [])), rule.code) for rule in rules]
        for name, rules in lists.items()
    }
    return first_rules(named, conditions, APPROVED)


def waterfall(rules: Sequence[Rule], member: Mapping[str, Column] | None = None) -> Column:
    """Reason code of the first rule that rejects the account."""
    return waterfalls({"rules": rules}, member)["rules"]


def roll_up(channel: str, code: str, rules: Sequence[Rule], month: str = "FechaFoto") -> list[tuple[Column, str]]:
    """Arms for one channel: rejected by a policy in force, rejected had it been in force, approved."""
    here = col("MarcaPreaprobado") == channel
    in_force, would_be = [], []
    for policy, since in EFFECTIVE[channel].items():
        codes = [r.code for r in rules if r.month == policy]
        known = lambda when: col(code).isin(*[c for c in codes if c not in NOT_ROLLED_UP[when]])
        label = IN_FORCE_LABEL.get((channel, policy), f"RECHAZADO {policy} FECHAS")
        in_force.append((here & (col(month) >= date_lit(since)) & known("in force"), label))
        would_be.append((here & known("would be"), f"RECHAZADO {policy}"))
    return [*in_force, *would_be, (here, "APROBADO")]


def roll_up_table(channel: str, rules: Sequence[Rule]) -> Column:
    """For each reason code of a channel: since when its policy is in force, and the labels from then on and before."""
    entries = []
    for code in dict.fromkeys(r.code for r in rules):
        policy = next(r.month for r in rules if r.code == code)
        would_be = f"RECHAZADO {policy}" if code not in NOT_ROLLED_UP["would be"] else "APROBADO"
        in_force = IN_FORCE_LABEL.get((channel, policy), f"RECHAZADO {policy} FECHAS") if code not in NOT_ROLLED_UP["in force"] else would_be
        entries += [F.lit(code), F.struct(date_lit(EFFECTIVE[channel][policy]).alias("since"), F.lit(in_force).alias("now"), F.lit(would_be).alias("before"))]
    return F.create_map(*entries)


def total_changes(month: str = "FechaFoto") -> Column:
    """What the reason code of the account's channel comes to, looked up by code."""
    out = F.lit("OTROS")
    for channel, code, rules in (("Preaprobado", "CambiosPreaprobadoSinT", PREAPPROVED), ("Espontaneo", "CambiosEspontaneo", SPONTANEOUS)):
        found = F.try_element_at(roll_up_table(channel, rules), col(code))
        label = F.when(found.isNull(), "APROBADO").when(col(month) >= found["since"], found["now"]).otherwise(found["before"])
        out = F.when(col("MarcaPreaprobado") == channel, label).otherwise(out)
    return out
