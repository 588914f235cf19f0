"""Six-sextant gum codes."""

from __future__ import annotations

from molaris.functions.sql import labelled

# Sextant codes and their names.
GUM_CODES = ["0", "1", "2", "3", "9"]
GUM_LABELS = {
    "0": "ปกติ",
    "1": "เลือดออก",
    "2": "เหงือกอักเสบ/หินน้ำลาย",
    "3": "ปริทันต์อักเสบ",
    "9": "ตรวจไม่ได้",
}
GUM_LENGTH = 6
GUM_UNREADABLE = "999999"


def normal_gum(c: str) -> str:
    """Trimmed text to a six-character code: itself, the unreadable code for other text,
    null for blank."""
    return (f"CASE WHEN length({c}) = {GUM_LENGTH} THEN {c} "
            f"WHEN length({c}) > 0 THEN '{GUM_UNREADABLE}' END")


def sextants(gum: str, code: str) -> str:
    """How many sextants carry ``code``; null when the gum code is blank."""
    return f"length({gum}) - length(replace({gum}, '{code}', ''))"


def gum_status(gum: str) -> str:
    """Highest readable code, 9 if none is readable, null when blank."""
    cases = " ".join(f"WHEN contains({gum}, '{c}') THEN '{c}'" for c in ("3", "2", "1", "0"))
    return f"CASE {cases} WHEN {gum} IS NOT NULL THEN '9' END"


def gum_label(status: str) -> str:
    """Name of a status code; null for unknown codes."""
    return labelled(status, GUM_LABELS)
