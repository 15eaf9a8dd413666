"""Column helpers. All of them stay inside generated JVM code."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400.0

# The markers that stand for a missing part of a key.
NULL_PART = "<<null>>"
KEY_SEPARATOR = "||"

# A bare year or year-month or a date with only an hour is not a timestamp, and
# a trailing type letter is not part of a number, although Spark's own casts
# would accept them. Dates may be written with slashes.
TIMESTAMP_SHAPE = r"^\s*\d{4}([-/])\d{1,2}\1\d{1,2}([ T]\d{1,2}:\d{1,2}.*)?\s*$"
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c: str | Column, upper: bool = False) -> Column:
    """Trimmed text, with blank read as missing."""
    c = col(c)
    return F.nullif(F.trim(F.upper(c) if upper else c), F.lit(""))


def safe_timestamp(c: str | Column) -> Column:
    """Zone-less timestamp, null where the text does not hold one."""
    c = col(c)
    return F.when(c.rlike(TIMESTAMP_SHAPE), F.translate(c, "/", "-").try_cast("timestamp_ntz"))


def safe_double(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.rlike(NUMBER_SHAPE), c.try_cast("double"))


def as_ntz(value: datetime | date | str) -> Column:
    """Zone-less timestamp literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Second boundaries crossed from start to end, as a whole number.

    Durations stay whole until the last division, so sums do not depend on the
    order in which tasks finish.
    """
    return F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))


def total_seconds(seconds: str | Column, times: str | Column | None = None) -> Column:
    """Exact sum of durations, each counted ``times`` over if given.

    The sum is a decimal: at some 10**11 rows in a group, which a third of a
    large log can be, whole seconds no longer fit in 64 bits.
    """
    value = col(seconds).cast("decimal(12,0)")
    return F.sum(value if times is None else value * col(times).cast("decimal(19,0)"))


def days(seconds: str | Column) -> Column:
    return col(seconds).cast("double") / F.lit(SECONDS_PER_DAY)


def days_between(start: str | Column, end: str | Column) -> Column:
    """Fractional days. A night from 23:00 to 01:00 is 2/24, not one day."""
    return days(seconds_between(start, end))


def surrogate_key(*parts: str | Column) -> Column:
    """Hash of the natural key: stable whatever else is in the table."""
    shown = [F.coalesce(col(p).cast("string"), F.lit(NULL_PART)) for p in parts]
    return F.md5(F.concat_ws(KEY_SEPARATOR, *shown))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """Quotient of two counts, null over zero."""
    return col(num).cast("double") / F.nullif(col(den), F.lit(0)).cast("double")


def changed(a: str | Column, b: str | Column) -> Column:
    """True where the two differ, a null counting as a value of its own."""
    return ~col(a).eqNullSafe(col(b))


def accepted(c: str | Column, values: list[str]) -> Column:
    """Null passes, as in every assertion here except not-null itself."""
    return col(c).isNull() | col(c).isin(values)


def rounded(c: str | Column, places: int = 6) -> Column:
    """Half-up rounding in plain double arithmetic, the same in any engine.

    Values too large to hold that many places are left as they are.
    """
    scale = float(10**places)
    shifted = F.floor(col(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(F.abs(col(c)) < F.lit(2.0**53 / scale), shifted).otherwise(col(c))
