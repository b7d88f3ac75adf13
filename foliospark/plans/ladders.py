"""Cut-offs and labels of every band."""

from __future__ import annotations

from collections.abc import Sequence

from foliospark.operators.rules import Ladder


def _steps(op: str, *pairs: tuple[float, str]) -> tuple[tuple[str, float, str], ...]:
    return tuple((op, float(bound), label) for bound, label in pairs)


# shared by the preapproval probability and the provision probability
PROBABILITY = Ladder(
    _steps(
        "<=",
        (0.05, "01. <= 5%"), (0.10, "02. >5 <=10%"), (0.15, "03. >10 <=15%"),
        (0.20, "04. >15 <=20%"), (0.25, "05. >20 <=25%"),
    ),
    otherwise="06. >25%",
)

GRADES = ["01. AAA", "02. AA", "03. A", "04. B", "05. C", "06. D", "07. E", "08. F", "09. G"]


def _grades(cuts: Sequence[float]) -> Ladder:
    return Ladder(_steps("<", *zip(cuts, GRADES)) + (("<=", 1.0, "10. H"),), otherwise="Otros")


GRADE_BEFORE = _grades([0.0150, 0.0320, 0.0550, 0.0800, 0.1020, 0.1542, 0.1736, 0.2030, 0.2397])
GRADE = _grades([0.0121, 0.0221, 0.0325, 0.0437, 0.0622, 0.0735, 0.0880, 0.1010, 0.1276])

CONSUMER_DEBT = Ladder(
    (("=", 0.0, "00. Sin deuda"),)
    + _steps(
        "<",
        (100e3, "01. < 100"), (500e3, "02. 100-500"), (1e6, "03. 500-1MM"), (5e6, "04. 1-5 MM"),
        (10e6, "05. 5-10MM"), (20e6, "06. 10-20MM"), (30e6, "07. 20-30MM"), (40e6, "08. 30-40MM"),
        (50e6, "09. 40-50MM"),
    )
    + ((">=", 50e6, "10. >= 50MM"),),
    otherwise="Otros",
)

_TENTHS = [
    "01. <= 10%", "02. 10-20%", "03. 20-30%", "04. 30-40%", "05. 40-50%",
    "06. 50-60%", "07. 60-70%", "08. 70-80%", "09. 80-90%", "10. 90-100%",
]
_TENTH_CUTS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]

DEBT_RATIO = Ladder(
    (("=", -1.0, "00. Sin info"),) + _steps("<=", *zip(_TENTH_CUTS, _TENTHS)) + ((">", 1.0, "11. > 100%"),),
    otherwise="Otros",
    null_label="00. Sin info",
)

# the first cut is strict, the others are not
DTI = Ladder(
    (("=", -1.0, "00. Sin DTI"), ("<", 0.1, "01. <= 10%"))
    + _steps("<=", *list(zip(_TENTH_CUTS, _TENTHS))[1:])
    + _steps("<=", (1.2, "11. 100-120%"), (1.5, "12. 120-150%"), (2.0, "13. 150-200%"))
    + ((">", 2.0, "14. > 200%"),),
    otherwise="Otros",
)

EVALUATED_INCOME = Ladder(
    _steps(
        "<=",
        (0, "01. Sin renta"), (300000, "02. <= 300"), (400000, "03. 300-=400"), (500000, "04. 400-=500"),
        (600000, "05. 500-=600"), (700000, "06. 600-=700"), (800000, "07. 700-=800"), (900000, "08. 800-=900"),
        (1000000, "09. 900-=1 MM"), (1200000, "10. 1-=1.2 MM"), (1500000, "11. 1.2-=1.5 MM"),
        (1700000, "12. 1.5-=1.7 MM"), (2000000, "13. 1.7-=2.0 MM"),
    )
    + ((">", 2000000.0, "14. > 2.0 MM"),),
    otherwise="Otros",
)

PILOT_INCOME = Ladder(
    _steps(
        "<=",
        (0, "01. Sin renta"), (300000, "02. <= 300"), (500000, "03. <=500"), (800000, "04. <=800"),
        (1500000, "05. <=1.5 MM"), (2000000, "06. <=2.0 MM"),
    )
    + ((">", 2000000.0, "07. > 2.0 MM"),),
    otherwise="Otros",
)

LIMIT = Ladder(
    _steps(
        "<=",
        (0, "01. Sin cupo"), (100000, "02. <= 100"), (300000, "03. 100-=300"), (400000, "04. 300-=400"),
        (500000, "05. 400-=500"), (600000, "06. 500-=600"), (700000, "07. 600-=700"), (800000, "08. 700-=800"),
        (900000, "09. 800-=900"), (1000000, "10. 900-=1 MM"), (1200000, "11. 1-=1.2 MM"),
        (1500000, "12. 1.2-=1.5 MM"), (1700000, "13. 1.5-=1.7 MM"), (2000000, "14. 1.7-=2.0 MM"),
    )
    + ((">", 2000000.0, "15. > 2.0 MM"),),
    otherwise="Otros",
)

# in months
AGE = Ladder(
    _steps(
        "<",
        (21 * 12, "01. < 21"), (25 * 12, "02. =21-25"), (30 * 12, "03. =25-30"), (35 * 12, "04. =30-35"),
        (40 * 12, "05. =35-40"), (45 * 12, "06. =40-45"), (50 * 12, "07. =45-50"), (55 * 12, "08. =50-55"),
        (60 * 12, "09. =55-60"), (65 * 12, "10. =60-65"), (70 * 12, "11. =65-70"), (75 * 12, "12. =70-75"),
    )
    + ((">=", 75.0 * 12, "13. >= 75"),),
    otherwise="Otros",
)

WEALTH = Ladder(
    (("=", 0.0, "00. Sin patrimonio"),)
    + _steps(
        "<=",
        (10e6, "01. <= 10MM"), (20e6, "02. 10-20MM"), (30e6, "03. 20-30MM"), (40e6, "04. 30-40MM"),
        (50e6, "05. 40-50MM"), (100e6, "06. 50-100MM"),
    )
    + ((">", 100e6, "07. > 100MM"),),
    otherwise="Otros",
)
