"""Quoting for expressions written as Spark SQL text."""

from __future__ import annotations

from collections.abc import Iterable


def quoted(value: str | None) -> str:
    """A string literal; NULL for None."""
    if value is None:
        return "CAST(NULL AS STRING)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def quoted_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def name(column: str) -> str:
    """A column name in backticks."""
    return "`" + column.replace("`", "``") + "`"


def labelled(value: str, labels: dict[str, str], otherwise: str = "NULL") -> str:
    """Label of a known value, ``otherwise`` for the rest."""
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in labels.items())
    return f"CASE {value} {cases} ELSE {otherwise} END"


def sentence(pattern: str, *parts: str) -> str:
    """A pattern with its ``%s`` places filled by text expressions."""
    return f"format_string({quoted(pattern)}, {', '.join(parts)})"
