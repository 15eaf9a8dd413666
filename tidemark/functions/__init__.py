from tidemark.functions.columns import (
    accepted,
    as_ntz,
    changed,
    days,
    days_between,
    norm_text,
    rounded,
    safe_double,
    safe_ratio,
    safe_timestamp,
    seconds_between,
    surrogate_key,
    total_seconds,
)
from tidemark.functions.temporal import (
    close_as_of,
    cohort_age_days,
    cohort_month,
    observable_watermark,
    within_target,
)

__all__ = [
    "accepted",
    "as_ntz",
    "changed",
    "close_as_of",
    "cohort_age_days",
    "cohort_month",
    "days",
    "days_between",
    "norm_text",
    "observable_watermark",
    "rounded",
    "safe_double",
    "safe_ratio",
    "safe_timestamp",
    "seconds_between",
    "surrogate_key",
    "total_seconds",
    "within_target",
]
