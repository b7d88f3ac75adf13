"""Every step of the two jobs as a query over the provided tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.dates import month_ends
from foliospark.plans import accounts, attributes, cohort, grouped, tracking
from foliospark.plans.params import CohortParams, TrackingParams
from foliospark.sources.io import co_located, store, stored_folder
from foliospark.sources.published import publish_partitions, read_published
from queries.mapping import Inputs

Query = Callable[[SparkSession, str], DataFrame]

# the orders span these months; all are read
COHORT = CohortParams(snapshots=month_ends("1995-01-01", "2001-12-01"))
# inputs stored by jobs that derive many of them
MANY = ("cohort_month", "lines")
COHORT_CAMPAIGN = CohortParams(snapshots=COHORT.snapshots, campaign_flag=1)


def _cohort(spark: SparkSession, sf_dir: str) -> tuple[Inputs, DataFrame, DataFrame]:
    t = Inputs(spark, sf_dir)
    return t, cohort.month_panel(t("cohort_month"), COHORT), cohort.campaign_clients(
        t("limit_campaign_stage1"), t("limit_campaign_stage2")
    )


def _follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, panel, campaign = _cohort(spark, sf_dir)
    increases = cohort.first_increase(cohort.limit_changes(panel, COHORT))
    return cohort.increase_follow_up(increases, campaign, panel, COHORT)


def limit_cohort_report(spark: SparkSession, sf_dir: str, params: CohortParams = COHORT) -> DataFrame:
    t = Inputs(spark, sf_dir)
    return cohort.limit_cohort(
        t("cohort_month"), t("limit_campaign_stage1"), t("limit_campaign_stage2"), params
    )


def _fraud(t: Inputs) -> DataFrame:
    return accounts.fraud_clients(
        t("fraud_clients_a"), t("fraud_clients_b"), t("fin_transactions"), t("fraud_transactions"),
        accounts.client_ids(t("client_id_map")),
    )


def _panel(t: Inputs) -> DataFrame:
    return accounts.account_panel(accounts.panel_rows(t("account_month_old"), t("account_month")))


def _params(t: Inputs) -> TrackingParams:
    """The job's, with as many buckets as the inputs have."""
    return replace(TrackingParams(), buckets=t.buckets)


def _openings(t: Inputs) -> DataFrame:
    return tracking.build_stock(t, _params(t))[1]


def _over_stock(step: Callable[[Inputs, DataFrame, DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Inputs(spark, sf_dir, MANY)
        panel, stock = tracking.build_stock(t, _params(t))
        return step(t, panel, stock)

    return query


def _over_inputs(step: Callable[[Inputs], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(Inputs(spark, sf_dir))


def _over_many(step: Callable[[Inputs], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(Inputs(spark, sf_dir, MANY))


def _co_located(step: Callable[[Inputs], DataFrame]) -> Query:
    """A step over many inputs that joins by the buckets they are stored in; its result is stored, as plans are made when they run."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with co_located(spark):
            return store(step(Inputs(spark, sf_dir, MANY)), "result")

    return query


def _enriched(t: Inputs) -> DataFrame:
    params = _params(t)
    panel, stock = tracking.build_stock(t, params)
    tables, right_hot = tracking.build_attributes(t, panel, stock, params)
    return tracking.enriched(stock, tables, right_hot=right_hot, params=params)


def _last_application(t: Inputs) -> DataFrame:
    params = _params(t)
    asked = tracking.asked_of(tracking.build_stock(t, params)[1], params)
    return attributes.last_application(asked, t("application_log"), params, buckets=t.buckets)


def _run(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the three published tables of a whole run."""
    folder = f"{stored_folder(spark)}/{uuid.uuid4().hex}"
    t = Inputs(spark, sf_dir, MANY)
    tracking.run_tracking(t, spark, folder, _params(t))
    return folder


def _report(name: str) -> Query:
    """A report as the job leaves it: published from the published tracking table, and read back."""
    return lambda spark, sf_dir: read_published(spark, f"{_run(spark, sf_dir)}/{name}")


REPLACED_MONTH = "2022-06-01"


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of the tracking table is replaced by half of its accounts with other limits, and the report refreshed."""
    folder = _run(spark, sf_dir)
    path, report = f"{folder}/tracking", f"{folder}/portfolio_grouped"
    month = read_published(spark, path, only=[REPLACED_MONTH])
    publish_partitions(month.filter("IdCliente % 2 = 0").withColumn("Cupo", F.col("Cupo") * 2), path, grouped.MONTH)
    again = grouped.refresh_report(spark, path, report, "portfolio_grouped")
    if again != [REPLACED_MONTH]:
        raise AssertionError(f"months aggregated again: {again}")
    return read_published(spark, report)


def _master(t: Inputs) -> DataFrame:
    return attributes.master_ids(t("client_master"))


def steps() -> dict[str, Query]:
    a = attributes
    out: dict[str, Query] = {
        "d_campaign_clients": lambda s, d: _cohort(s, d)[2],
        "d_month_panel": lambda s, d: _cohort(s, d)[1],
        "d_limit_changes": lambda s, d: cohort.limit_changes(_cohort(s, d)[1], COHORT),
        "d_first_increase": lambda s, d: cohort.first_increase(cohort.limit_changes(_cohort(s, d)[1], COHORT)),
        "d_increase_follow_up": _follow,
        "d_increase_pivot": lambda s, d: cohort.increase_pivot(_follow(s, d)),
        "q_limit_cohort_report": limit_cohort_report,
        "q_limit_cohort_report_campaign": lambda s, d: limit_cohort_report(s, d, COHORT_CAMPAIGN),
        "d_client_ids": _over_inputs(lambda t: accounts.client_ids(t("client_id_map"))),
        "d_fraud_clients": _over_inputs(_fraud),
        "d_fraud_contracts": _over_inputs(lambda t: accounts.fraud_contracts(t("fraud_contracts"))),
        "d_account_panel": _over_inputs(_panel),
        "d_permanent_blocks": _over_inputs(lambda t: accounts.permanent_blocks(t("contract_blocks"))),
        "d_openings": _over_many(_openings),
        "d_renegotiated": _over_stock(lambda t, p, s: accounts.renegotiated(t("card_events"), s)),
        "d_estimated_income": _over_inputs(lambda t: a.estimated_income(t("income_logic"))),
        "d_bureau_windows": _over_inputs(lambda t: a.bureau_windows(t("bureau_month"), buckets=t.buckets)),
        "d_vintage_outcomes": _over_stock(lambda t, p, s: a.vintage_outcomes(s, p)),
        "d_preapproval_grade": _over_inputs(lambda t: a.preapproval_grade(t("preapproval_scores"))),
        "d_preapproval_grade_restated": _over_inputs(
            lambda t: a.preapproval_grade_restated(t("preapproval_scores_restated"))
        ),
        "d_mini_policy": _over_inputs(lambda t: a.mini_policy(t("mini_policy"))),
        "d_vehicle_wealth": _over_stock(
            lambda t, p, s: a.vehicle_wealth(tracking.asked_of(s, _params(t)), t("vehicles"), _master(t), buckets=t.buckets)
        ),
        "d_property_wealth": _over_stock(
            lambda t, p, s: a.property_wealth(s, t("real_estate_month"), t("houses"), _master(t))
        ),
        "d_preapproved_base": _over_inputs(lambda t: a.preapproved_base(t("preapproved_base"))),
        "d_person_latest": _over_inputs(
            lambda t: a.person_latest(t("bureau_person"), accounts.client_ids(t("client_id_map")))
        ),
        "d_last_application": _co_located(_last_application),
        "d_retail_spend": _over_stock(
            lambda t, p, s: a.retail_spend(s, t("retail_spend_s"), t("retail_spend_f"), t("retail_spend_t"))
        ),
        "d_provision_pd": _over_inputs(lambda t: a.provision_pd(t("provision_pd"))),
        "d_pilot_income": _over_inputs(lambda t: a.pilot_income(t("income_pilot"))),
        "d_enriched": _co_located(_enriched),
        "d_segmented": _co_located(lambda t: tracking.segmented(_enriched(t))),
        "d_tracking": _co_located(lambda t: tracking.build_tracking(t, _params(t))),
        "q_portfolio_grouped": _report("portfolio_grouped"),
        "q_portfolio_grouped_changes": _report("portfolio_grouped_changes"),
        "q_portfolio_grouped_refreshed": _refreshed,
    }
    return out
