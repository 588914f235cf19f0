"""Rounding and ratios that do not depend on an engine's own ``round``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def round_half_even(x: str, places: int = 2) -> str:
    """Correctly rounded half-even result of the exact binary value of the double ``x``.

    The fraction is split into a 26-bit head and a tail, so the distance to the tie
    is exact; ``round`` and ``bround`` work on scaled values and miss some ties. ``x`` is
    repeated, so it should be a column.
    """
    if not 0 <= places <= 4:
        raise ValueError("places must be between 0 and 4")
    scale, twice = f"{10**places}D", f"{2 * 10**places}D"
    whole = f"floor(abs({x}))"
    part = f"(abs({x}) - {whole})"
    head = f"(floor({part} * 67108864D) / 67108864D)"
    step = f"floor({part} * {scale})"
    over = f"(({head} * {twice} - (2 * {step} + 1)) + ({part} - {head}) * {twice})"
    last_digit = step if places else whole
    up = f"CASE WHEN {over} > 0 OR ({over} = 0 AND {last_digit} % 2 = 1) THEN 1 ELSE 0 END"
    # From 2**52 on a double has no fraction.
    return (f"CASE WHEN abs({x}) < 4503599627370496D "
            f"THEN sign({x}) * ({whole} * {scale} + {step} + {up}) / {scale} ELSE {x} END")


def ratio(total: str, base: str) -> str:
    """``total / base`` as double; null when the base is zero or null."""
    return f"CAST({total} AS DOUBLE) / CAST(nullif({base}, 0) AS DOUBLE)"


def percent(n: str, base: str) -> str:
    """``100 * n / base`` as double; null when the base is zero or null."""
    return ratio(f"100D * {n}", base)


def scaled_percent(x: str) -> str:
    """A percent with two places by scaling: ``rint(100 x) / 100``; 0 for null."""
    return f"coalesce(rint({x} * 100) / 100, 0D)"


def with_rounded(df: DataFrame, values: dict[str, tuple[str, int]]) -> DataFrame:
    """Add columns ``name: (expression, places)``, rounded.

    The unrounded values are columns of their own first, as the rounding names them often.
    """
    raw = df.selectExpr("*", *[f"{x} AS `_raw {c}`" for c, (x, _) in values.items()])
    kept = [f"`{c}`" for c in df.columns]
    return raw.selectExpr(*kept, *[
        f"{round_half_even(f'`_raw {c}`', places)} AS `{c}`" for c, (_, places) in values.items()])


def shown(x: str, places: int = 2) -> str:
    """Number as text with thousands separators, half-even; ``-`` for null."""
    return f"coalesce(format_number({x}, {places}), '-')"
