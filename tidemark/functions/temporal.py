"""Column helpers for as-of state, cohorts and targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import Params
from tidemark.functions.columns import as_ntz, col, days, days_between


def close_as_of(closed: str | Column, cutoff: Column) -> Column:
    """The close as known at ``cutoff``; one on the cutoff itself is known."""
    closed = col(closed)
    return F.when(closed <= cutoff, closed)


def observable_watermark(created: str | Column, known_close: str | Column) -> Column:
    """Latest change visible so far. A close still to come cannot move it."""
    created, known_close = col(created), col(known_close)
    return F.greatest(created, F.coalesce(known_close, created))


def cohort_month(created: str | Column) -> Column:
    return F.trunc(col(created).cast("date"), "MM")


def cohort_age_days(month: str | Column, params: Params) -> Column:
    """Days from the last second of the month to the build instant."""
    next_month = F.add_months(col(month), 1).cast("timestamp_ntz")
    last_second = next_month - F.expr("interval 1 second")
    return days_between(last_second, as_ntz(params.build_as_of))


def within_target(seconds_to_close: Column, seconds_open: Column, target_days: int) -> Column:
    """Three-valued outcome: an open request inside its target has none yet."""
    return F.when(
        seconds_to_close.isNotNull(), days(seconds_to_close) <= F.lit(float(target_days))
    ).when(days(seconds_open) > F.lit(float(target_days)), F.lit(False))
