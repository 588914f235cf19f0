"""Completed years and months between two dates."""

from __future__ import annotations


def years_between(birth: str, at: str) -> str:
    """Completed years; the birthday itself counts. Null if either date is null."""
    before_birthday = f"month({at}) * 100 + day({at}) < month({birth}) * 100 + day({birth})"
    return f"year({at}) - year({birth}) - CAST({before_birthday} AS INT)"


def months_between(birth: str, at: str) -> str:
    """Completed months by calendar day, not by month length."""
    return (f"(year({at}) - year({birth})) * 12 + (month({at}) - month({birth})) "
            f"- CAST(day({at}) < day({birth}) AS INT)")
