"""The same build with faults planted in its tables, so that assertions have something to find.

Which rows are spoilt follows from the digits of a key, so the SQL that the
result is compared with can spoil the same ones.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans import staging
from tidemark.plans.warehouse import Warehouse


def _ends(column: str, *digits: str) -> Column:
    return F.coalesce(F.right(F.col(column), F.lit(2)).isin(*digits), F.lit(False))


class Spoilt(Warehouse):
    """A warehouse over the tables of another, with faults in every kind of check."""

    def __init__(self, sound: Warehouse):
        super().__init__(sound.spark, sound.landing, sound.params, sound.store)
        self.sound = sound

    @cached_property
    def staged(self) -> DataFrame:
        rows = self.sound.staged
        again = rows.filter(_ends("request_id", "11"))
        lost = F.when(~_ends("request_id", "12"), F.col("source_updated_at"))
        return rows.unionByName(again).withColumn("source_updated_at", lost)

    @cached_property
    def fact(self) -> DataFrame:
        rows = self.sound.fact.filter(~_ends("request_id", "21"))
        rows = rows.unionByName(rows.filter(_ends("request_id", "22")))

        def lost(column: str, digits: str) -> Column:
            return F.when(~_ends("request_id", digits), F.col(column))

        def unknown(column: str, digits: str) -> Column:
            return F.when(_ends("request_id", digits), F.lit("nowhere")).otherwise(F.col(column))

        day = F.expr("interval 1 day")
        return rows.withColumns(
            {
                "is_closed": lost("is_closed", "23"),
                "agency_key": unknown("agency_key", "24"),
                "geography_key": unknown("geography_key", "25"),
                "complaint_type_key": unknown("complaint_type_key", "26"),
                "created_date_key": F.when(_ends("request_id", "27"), F.lit("2090-01-01").cast("date")).otherwise(
                    F.col("created_date_key")
                ),
                "latitude": F.when(_ends("request_id", "28"), F.lit(1.0)).otherwise(F.col("latitude")),
                "closed_at": F.when(_ends("request_id", "29"), F.col("created_at") - day).otherwise(F.col("closed_at")),
                "age_days": F.when(_ends("request_id", "30"), F.lit(-1.0)).otherwise(F.col("age_days")),
                "created_at": F.when(_ends("request_id", "31"), F.lit("1990-01-01").cast("timestamp_ntz")).otherwise(
                    F.col("created_at")
                ),
            }
        )

    @cached_property
    def quarantined(self) -> DataFrame:
        reason = F.when(_ends("request_id", "41"), F.lit("because")).when(~_ends("request_id", "42"), F.col("exclusion_reason"))
        rows = staging.quarantined(self.staged).filter(~_ends("request_id", "43"))
        return rows.withColumn("exclusion_reason", reason)

    @cached_property
    def dim_agency(self) -> DataFrame:
        rows = self.sound.dim_agency
        return rows.unionByName(rows.filter(F.col("agency_key").startswith("B")))

    @cached_property
    def dim_complaint_type(self) -> DataFrame:
        """Versions twice, with the second copy current and a day too early."""
        rows = self.sound.dim_complaint_type
        again = rows.filter(~F.col("is_unknown_member") & F.col("complaint_type_key").rlike("^[0-3]"))
        return rows.unionByName(
            again.withColumns(
                {
                    "is_current": F.lit(True),
                    "valid_from_at": F.col("valid_from_at") - F.expr("interval 1 day"),
                    "valid_to_at": F.when(F.col("version_number") != 2, F.col("valid_to_at")),
                }
            )
        )

    @cached_property
    def agency_month(self) -> DataFrame:
        """A rate beyond one, and a measure that no metric describes."""
        rate = F.when(F.col("agency_key").startswith("M"), F.lit(1.5)).otherwise(F.col("closure_rate"))
        return self.sound.agency_month.withColumn("closure_rate", rate).withColumn("guess", F.lit(0.5))

    @cached_property
    def replayable(self) -> DataFrame:
        return self.sound.replayable

    @cached_property
    def merged(self) -> DataFrame:
        rows = self.sound.merged
        return rows.unionByName(rows.filter(_ends("request_id", "51")))
