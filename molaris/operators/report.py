"""Report tables as projections of the rolled-up rows: long form and wide form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from molaris.functions.numeric import percent, ratio, round_half_even
from molaris.functions.sql import name as column_name, quoted
from molaris.operators.cells import AREA_KEYS, LEVELS, TOTAL, Measures, build_cells, report_rows
from molaris.plans import labels as L
from molaris.plans.rules import MEAN, QUALITY, Profile, Table

PASS = "pass"
CHECK = "check"
METRIC = "metric"


def row_label(profile: Profile) -> str:
    """Age, band label or the total label of a report row."""
    bands = " ".join(f"WHEN row_kind = 'band' AND row_ord = {i} THEN {quoted(band.label)}"
                     for i, band in enumerate(profile.bands))
    return (f"CASE WHEN row_kind = '{TOTAL}' THEN {quoted(L.TOTAL_LABEL)} "
            f"WHEN row_kind = 'age' THEN CAST(row_ord AS STRING) {bands} END")


def _shows(table: Table) -> str:
    return f"row_kind IN ('{table.row_kind}', '{TOTAL}')"


def _figures(profile: Profile, m: Measures) -> list[tuple[Table, int, str, str, str, str, str]]:
    """(table, metric position, role, name, base, count, sum) of every figure in the report."""
    out = []
    for table in profile.tables:
        if table.kind == QUALITY:
            out.append((table, 0, PASS, L.PASSED_LABEL, m.examined, m.qualified, "NULL"))
            for i, check in enumerate(profile.quality_checks, start=1):
                out.append((table, i, CHECK, check.name, m.applies(check), m.fails(check), "NULL"))
        else:
            for i, metric in enumerate(table.metrics):
                mean = table.kind == MEAN
                out.append((table, i, METRIC, metric.name, m.base(table),
                            "NULL" if mean else m.count(table, metric.rule),
                            m.total(table, metric.rule) if mean else "NULL"))
    return out


def long_report(rows: DataFrame, profile: Profile) -> DataFrame:
    """One row per area, table, report row and metric.

    ``value`` is the percent (count and quality tables) or the mean (mean tables); a quality
    table has its pass rate as metric 0 and its checks after it.
    """
    m = Measures(profile)
    figures = ", ".join(
        f"IF({_shows(table)}, struct({profile.tables.index(table)} AS table_ord, {quoted(table.no)} AS table_no, "
        f"'{table.kind}' AS kind, {i} AS metric_ord, '{role}' AS role, {quoted(name)} AS metric, "
        f"{table.decimals} AS decimals, {base} AS base, CAST({count} AS BIGINT) AS n, "
        f"CAST({total} AS DOUBLE) AS total), NULL)"
        for table, i, role, name, base, count, total in _figures(profile, m)
    )
    places = sorted({t.decimals for t in profile.tables})
    value = " ".join(f"WHEN {p} THEN {round_half_even('_x', p)}" for p in places)
    figured = (
        rows.selectExpr("level", *AREA_KEYS, "row_kind", "row_ord", f"explode(array({figures})) AS f")
        .where("f IS NOT NULL")
        .selectExpr("level", *AREA_KEYS, "row_kind", "row_ord", "f.*")
    )
    return figured.selectExpr(
        "*", f"IF(kind = '{MEAN}', {ratio('total', 'base')}, {percent('n', 'base')}) AS _x",
    ).selectExpr(
        "level", *AREA_KEYS, "table_ord", "table_no", "kind", "row_ord",
        f"{row_label(profile)} AS row_label", f"row_kind = '{TOTAL}' AS is_total",
        "metric_ord", "role", "metric", "base", "n", "total", f"CASE decimals {value} END AS value",
    )


def report(df: DataFrame, profile: Profile, levels: Iterable[str] = ("all",),
           facilities: DataFrame | None = None) -> DataFrame:
    """All tables of a profile in long form, from prepared records, at the given levels.

    ``facilities`` as in ``build_cells``.
    """
    return long_report(report_rows(build_cells(df, profile, facilities), profile, levels), profile)


def _wide_columns(profile: Profile, table: Table) -> list[tuple[str, str, bool]]:
    """(heading, expression, is a rounded figure) of the columns of one table."""
    m = Measures(profile)
    columns = [(L.ROW_LABELS[table.row_kind], row_label(profile), False)]
    if table.kind == QUALITY:
        columns += [(L.EXAMINED_LABEL, m.examined, False), (L.PASSED_LABEL, m.qualified, False),
                    (L.PERCENT_LABEL, percent(m.qualified, m.examined), True)]
        for check in profile.quality_checks:
            fails = m.fails(check)
            columns += [(L.FAILED_CHECK + check.name, fails, False),
                        (L.FAILED_CHECK_PERCENT + check.name, percent(fails, m.applies(check)), True)]
        return columns
    base = m.base(table)
    columns.append((L.BASE_LABEL, base, False))
    for metric in table.metrics:
        if table.kind == MEAN:
            columns.append((metric.name, ratio(m.total(table, metric.rule), base), True))
        else:
            hits = m.count(table, metric.rule)
            columns += [(f"{metric.name} - {L.COUNT_LABEL}", hits, False),
                        (f"{metric.name} - {L.PERCENT_LABEL}", percent(hits, base), True)]
    return columns


def wide_table(rows: DataFrame, profile: Profile, no: str, with_area: bool = False) -> DataFrame:
    """One table as shown: a row per age or band, the total last. A projection, no pivot.

    Headings are flat (``metric - part``).
    """
    table = profile.table(no)
    columns = _wide_columns(profile, table)
    areas = ["level", *AREA_KEYS] if with_area else []
    shown = rows.where(_shows(table)).selectExpr(
        *areas, f"row_kind = '{TOTAL}' AS _last", "row_ord AS _position",
        *[f"{x} AS {column_name(title)}" for title, x, _ in columns])
    final = [f"{round_half_even(column_name(t), table.decimals)} AS {column_name(t)}" if r else column_name(t)
             for t, _, r in columns]
    return shown.orderBy(*areas, "_last", "_position").selectExpr(*areas, *final)


__all__ = ["LEVELS", "long_report", "report", "row_label", "wide_table"]
