"""Parameters every builder takes. Nothing in the package reads a clock."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import date, datetime
from typing import Any

# Shortest length in days of one step of each cadence.
CADENCE_MIN_DAYS = {"day": 1, "week": 7, "month": 28, "quarter": 90}


@dataclass(frozen=True)
class Params:
    """Window, cutoffs and targets of one build.

    ``build_as_of`` stands in for "now" and is always required.
    """

    window_start: datetime
    window_end: datetime
    build_as_of: datetime
    vintage_first: date
    vintage_cadence: str = "month"
    sla_target_days: int = 30
    maturity_window_days: int = 90
    sensitivity_windows: tuple[int, ...] = (30, 60, 90, 120, 180)
    lat_bounds: tuple[float, float] = (40.4, 41.0)
    lon_bounds: tuple[float, float] = (-74.3, -73.7)
    report_min_volume: int = 1000
    # A lookup side is broadcast only after its rows were counted and found to
    # be at most this many; above it the join shuffles.
    broadcast_max_rows: int = 200_000

    def __post_init__(self) -> None:
        if self.vintage_cadence not in CADENCE_MIN_DAYS:
            raise ValueError(f"unknown vintage_cadence {self.vintage_cadence!r}")
        if self.window_end <= self.window_start:
            raise ValueError("window_end must be after window_start")

    def vintage_count_bound(self) -> int:
        """Upper bound on the number of vintages, known without running a job."""
        days = (self.build_as_of.date() - self.vintage_first).days
        return max(days, 0) // CADENCE_MIN_DAYS[self.vintage_cadence] + 3

    def bin_count_bound(self) -> int:
        """Upper bound on the calendar bins that all periods touch together.

        Neighbouring periods share at most the bin that their border lies in.
        """
        first = min(self.window_start.date(), self.vintage_first)
        step = {"day": 1, "week": 7}.get(self.vintage_cadence, 28)
        days = max((self.build_as_of.date() - first).days, 0) + 31
        return days // step + 2 + 2 * self.vintage_count_bound()

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> "Params":
        """From a parsed configuration file: ISO texts and plain values."""
        stamps = ("window_start", "window_end", "build_as_of")
        read = dict(values)
        for name in stamps:
            if isinstance(read.get(name), str):
                read[name] = datetime.fromisoformat(read[name])
        if isinstance(read.get("vintage_first"), str):
            read["vintage_first"] = date.fromisoformat(read["vintage_first"])
        for name in ("sensitivity_windows", "lat_bounds", "lon_bounds"):
            if name in read:
                read[name] = tuple(read[name])
        return cls(**read)

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


def resolve_window_end(manifest_end: str | None, configured_end: str | None) -> datetime:
    """The recorded end of the pull wins over the configured one; there is no
    fallback to the current time, so a build can always be repeated."""
    for candidate in (manifest_end, configured_end):
        if candidate:
            return datetime.fromisoformat(candidate)
    raise ValueError("no window end: neither the manifest nor the configuration has one")
