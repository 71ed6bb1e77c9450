"""Settings of an analysis, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

FREQUENCIES = ("daily", "hourly", "intraday")


@dataclass(frozen=True)
class DataSettings:
    frequency: str = "daily"
    date_column: str = "Date"
    minimum_observations: int = 2
    drop_incomplete_rows: bool = False
    require_positive_prices: bool = True

    def __post_init__(self):
        if self.frequency not in FREQUENCIES:
            raise ValueError(f"frequency must be one of {FREQUENCIES}")
        if not self.date_column or self.date_column.isspace():
            raise ValueError("a date column needs a name")
        if self.minimum_observations < 2:
            raise ValueError("two observations are the least")


@dataclass(frozen=True)
class WindowSettings:
    short: int = 60
    medium: int = 126
    annual: int = 252
    long: int = 504

    def __post_init__(self):
        row = (self.short, self.medium, self.annual, self.long)
        if row[0] < 1 or any(a > b for a, b in zip(row, row[1:], strict=False)):
            raise ValueError("windows must be positive and in ascending order")


@dataclass(frozen=True)
class JournalSettings:
    root: str = "predictions/private"
    allow_overwrite: bool = False
