"""Run dates and frozen plans."""

from __future__ import annotations

import datetime as dt

HORIZON_DAYS = 28


def initial_range(text: str) -> tuple[dt.date, dt.date]:
    """FROM:TO of an initial plan; FROM must not be after TO."""
    first, _, last = text.partition(":")
    a, b = dt.date.fromisoformat(first.strip()), dt.date.fromisoformat(last.strip())
    if a > b:
        raise ValueError(f"{text}: starts after it ends")
    return a, b


def is_usual_span(span: tuple[dt.date, dt.date]) -> bool:
    """Whether a plan covers as many days as a forecast does."""
    return (span[1] - span[0]).days + 1 == HORIZON_DAYS


def run_date(explicit: str | None, initial: tuple[dt.date, dt.date] | None, last_data: dt.date) -> dt.date:
    """The given date, else the day before the initial plan, else the last day of data."""
    if explicit:
        return dt.date.fromisoformat(explicit)
    return initial[0] - dt.timedelta(days=1) if initial else last_data
