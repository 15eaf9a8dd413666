"""The whole build: each table is made on first use and stored where several
later tables read it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import Params
from tidemark.operators import periods as cal
from tidemark.plans import dimensions, fact, ledger, marts, replay, staging
from tidemark.store import Store


class Warehouse:
    """Tables over one landing log. ``store`` decides where they are kept.

    The log is read as it is given; hand in a stored table when it is costly to
    derive, since staging, ledger and profile each read it.
    """

    def __init__(self, spark: SparkSession, landing: DataFrame, params: Params, store: Store | None = None):
        self.spark = spark
        self.params = params
        self.store = store or Store(spark)
        self.landing = landing

    def build(self) -> dict[str, DataFrame]:
        """Make every table, in the order in which they read each other."""
        names = (
            "staged", "valid", "quarantined", "ledger", "vintages", "observations",
            "dim_agency", "dim_geography", "dim_date", "dim_complaint_type", "fact",
            "agency_month", "cohort_maturity", "bi_wide",
            "append_only", "merged", "drift_log", "drift_summary",
        )
        return {name: getattr(self, name) for name in names}

    @cached_property
    def staged(self) -> DataFrame:
        return self.store.table("staging", "stg_service_requests", staging.stage(self.landing, self.params))

    @cached_property
    def valid(self) -> DataFrame:
        return staging.valid(self.staged)

    @cached_property
    def quarantined(self) -> DataFrame:
        return staging.quarantined(self.staged)

    @cached_property
    def ledger(self) -> DataFrame:
        return ledger.ledger(self.landing, self.staged, self.quarantined, self.valid)

    @cached_property
    def periods(self) -> DataFrame:
        return cal.periods(self.spark, self.params)

    @cached_property
    def vintages(self) -> DataFrame:
        return cal.vintages(self.spark, self.params)

    @cached_property
    def observations(self) -> DataFrame:
        return self.store.table(
            "intermediate",
            "type_observations",
            dimensions.type_observations(self.valid, self.periods, self.params),
        )

    @cached_property
    def dim_agency(self) -> DataFrame:
        return self.store.table("marts", "dim_agency", dimensions.dim_agency(self.valid))

    @cached_property
    def dim_geography(self) -> DataFrame:
        return self.store.table("marts", "dim_geography", dimensions.dim_geography(self.valid))

    @cached_property
    def dim_date(self) -> DataFrame:
        return self.store.table("marts", "dim_date", dimensions.dim_date(self.spark, self.params))

    @cached_property
    def dim_complaint_type(self) -> DataFrame:
        return self.store.table(
            "marts",
            "dim_complaint_type",
            dimensions.dim_complaint_type(self.observations, self.valid, self.periods, self.params),
        )

    @cached_property
    def fact(self) -> DataFrame:
        return self.store.table(
            "marts",
            "fct_service_request",
            fact.fact_service_request(self.valid, self.dim_complaint_type, self.params),
        )

    @cached_property
    def durations(self) -> DataFrame:
        """Histogram of the fact that both marts and the sensitivity report read."""
        return self.store.table(
            "intermediate", "durations", marts.durations(self.fact, self.dim_geography, self.params)
        )

    @cached_property
    def agency_month(self) -> DataFrame:
        return self.store.table("marts", "mart_agency_month", marts.agency_month(self.durations, self.params))

    @cached_property
    def cohort_maturity(self) -> DataFrame:
        return self.store.table("marts", "mart_cohort_maturity", marts.cohort_maturity(self.durations, self.params))

    @cached_property
    def bi_wide(self) -> DataFrame:
        return self.store.table(
            "marts",
            "mart_bi_wide",
            marts.bi_wide(self.agency_month, self.dim_agency, self.dim_complaint_type, self.dim_date, self.params),
        )

    @cached_property
    def replayable(self) -> DataFrame:
        return replay.require_unique_ids(self.valid)

    @cached_property
    def append_only(self) -> DataFrame:
        return replay.append_only_table(self.replayable, self.periods, self.params)

    @cached_property
    def merged(self) -> DataFrame:
        return replay.merge_table(self.replayable, self.periods, self.params)

    @cached_property
    def drift_log(self) -> DataFrame:
        return self.store.table(
            "comparison", "vintage_drift_log", replay.drift(self.replayable, self.periods, self.params)
        )

    @cached_property
    def replayed(self) -> replay.Replayed:
        """Every vintage run through both loads: the log, and the tables as the last run left them."""
        return replay.replay(self.replayable, self.periods, self.store)

    @cached_property
    def drift_summary(self) -> DataFrame:
        return replay.drift_summary(self.drift_log)
