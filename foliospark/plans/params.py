"""Dates and switches of the two jobs. The defaults are fixed values of the business rules."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from foliospark.functions.dates import month_ends
from foliospark.operators.history import Months
from foliospark.operators.reduction import ReductionPolicy
from foliospark.operators.skew import SkewPolicy


@dataclass(frozen=True)
class TrackingParams:
    old_first: str = "2021-01-01"
    old_last: str = "2022-04-01"
    new_snapshots: list[dt.date] = field(default_factory=lambda: month_ends("2022-05-01", "2023-04-01"))
    openings_from: str = "2021-01-01"
    blocks_from: str = "2022-01-01"
    block_needed_from: str = "2022-08-01"  # a reopening needs a block on record from here on
    events_after: str = "2021-01-01"
    income_from: str = "2020-12-01"
    bureau_from: str = "2020-11-01"
    bureau_history_from: str = "2020-06-01"
    scores_from: str = "2020-11-01"
    scores_regime: str = "2022-08-01"
    restated_from: str = "2021-06-01"
    policy_from: str = "2020-12-01"
    wealth_before: str = "2022-01-01"
    real_estate_from: str = "2020-06-01"
    person_from: str = "2021-01-01"
    applications_from: str = "2020-09-01"
    retail_from: str = "2020-12-01"
    provision_from: str = "2020-12-01"
    pilot_from: str = "2022-07-01"
    # the record entered as a trial: opening month, birth date, limit
    trial_record: tuple[str, str, float] = ("2022-09-01", "1990-05-05", 50000.0)
    skew: SkewPolicy = SkewPolicy()
    reduction: ReductionPolicy = ReductionPolicy()
    buckets: int | None = None  # of the stored panel, openings and outcomes; None: as many as shuffle partitions, 0: no buckets

    @property
    def panel_months(self) -> Months:
        """From the first opening to the last snapshot."""
        last = max(dt.date.fromisoformat(self.old_last), *self.new_snapshots)
        return Months(dt.date.fromisoformat(self.openings_from).replace(day=1), last.replace(day=1))

    @property
    def wealth_from(self) -> str:
        """Twelve months before the first opening: no as-of value is older."""
        first = dt.date.fromisoformat(self.openings_from)
        return first.replace(year=first.year - 1).isoformat()


@dataclass(frozen=True)
class CohortParams:
    snapshots: list[dt.date] = field(default_factory=lambda: month_ends("2022-06-01", "2023-04-01"))
    campaign_flag: int = 0
