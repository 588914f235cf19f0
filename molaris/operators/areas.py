"""Headline figures, reconciliation, area breakdowns and the area tree, all from cells."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from molaris.functions.numeric import percent, ratio, round_half_even, scaled_percent
from molaris.functions.sql import quoted
from molaris.functions.text import strip
from molaris.operators.cells import AREA_KEYS, Measures, at_levels
from molaris.operators.lookup import attach_area
from molaris.plans import labels as L
from molaris.plans.rules import Profile


def headline(cells: DataFrame, profile: Profile, levels: Iterable[str] = ("all",)) -> DataFrame:
    """Counts, percents, facilities, districts and service dates per area.

    Distinct facilities and districts are counted over cells, not over records. The
    reconciliation holds by construction: target = examined + pending + out_of_range.
    """
    m = Measures(profile)
    levels = list(levels)
    if levels == ["all"]:
        # No grouping, so that the row is there even without records.
        grouped = cells.withColumnsRenamed({"hoscode": "_hoscode", "ampname": "_ampname"}).groupBy()
        areas = ["'all' AS level", *[f"CAST(NULL AS STRING) AS {k}" for k in AREA_KEYS]]
    else:
        areas = ["level", *AREA_KEYS]
        grouped = at_levels(cells, levels).groupBy(*areas)
    counts = {"target": m.target, "examined": m.examined, "pending": m.pending, "qualified": m.qualified}
    totals = grouped.agg(
        *[F.expr(f"coalesce(sum({c}), 0) AS {name}") for name, c in counts.items()],
        F.expr(f"count(DISTINCT IF({m.examined} > 0, _hoscode, NULL)) AS hospitals"),
        F.expr(f"count(DISTINCT IF({m.examined} > 0, _ampname, NULL)) AS districts"),
        F.expr("min(date_min) AS date_min"),
        F.expr("max(date_max) AS date_max"),
    )
    return totals.selectExpr(
        "*", f"{percent('qualified', 'examined')} AS _q", f"{percent('examined', 'target')} AS _e",
    ).selectExpr(
        *areas, "examined", "qualified", f"{scaled_percent('_q')} AS qualified_pct", "hospitals", "districts",
        *[f"coalesce(date_format({c}, 'yyyy-MM-dd'), '-') AS {c}" for c in ("date_min", "date_max")],
        "target", f"{round_half_even('_e')} AS examined_pct", "pending",
        "target - examined - pending AS out_of_range",
    )


def breakdown(cells: DataFrame, profile: Profile, by: str = "district") -> DataFrame:
    """Figures per district name (``district``) or per facility (``unit``), in report order.

    Districts are keyed by name alone, so equal names in two provinces are one row. Where
    a key has several codes or names the smallest is shown; records have no first row.
    """
    m = Measures(profile)
    key, code, name = {"district": ("ampname", "ampcode", "ampname"),
                       "unit": ("hoscode", "hoscode", "hosname")}[by]
    counts = {"target": m.target, "examined": m.examined, "pending": m.pending,
              "qualified": m.qualified, "caries_free": m.caries_free, "_dmft": m.dmft}
    unknown = quoted(L.UNKNOWN_AREA)
    grouped = cells.selectExpr(
        f"{key} AS _key", f"{code} AS _code", f"nullif({name}, '') AS _name",
        *[f"{c} AS {title}" for title, c in counts.items()],
    ).groupBy("_key").agg(
        F.expr("coalesce(min(_code), '') AS code"), F.expr("min(_name) AS _name"),
        *[F.expr(f"sum({title}) AS {title}") for title in counts])
    return grouped.selectExpr(
        "*", f"{percent('examined', 'target')} AS _e", f"{percent('qualified', 'examined')} AS _q",
        f"{percent('caries_free', 'qualified')} AS _c", f"{ratio('_dmft', 'qualified')} AS _d",
    ).selectExpr(
        f"coalesce(_key, {unknown}) AS key", "code", f"coalesce(_name, nullif(_key, ''), {unknown}) AS name",
        "target", "examined", "pending", "examined - qualified AS failed",
        f"{round_half_even('_e')} AS examined_pct", "qualified", f"{round_half_even('_q')} AS qualified_pct",
        "caries_free", f"{round_half_even('_c')} AS caries_free_pct", f"{round_half_even('_d')} AS dmft",
    ).orderBy(F.expr("nullif(code, '')").asc_nulls_last(), "name", "key")


def _units(df: DataFrame, facilities: DataFrame | None, columns: Iterable[str]) -> DataFrame:
    """The distinct facilities of the records with their area: only these are looked up."""
    if facilities is None:
        return df
    area = set(facilities.columns)
    own = [c for c in dict.fromkeys(["hoscode", "hosname", *columns]) if c in df.columns and (c not in area or c in ("hoscode", "hosname"))]
    return attach_area(df.select(*own).distinct(), facilities)


def area_tree(df: DataFrame, facilities: DataFrame | None = None) -> DataFrame:
    """Province, district and facility nodes as sorted rows (a district may be very large,
    so its facilities are rows, not one array). Given the facilities, records need no area columns.

    Blank names become the unknown label; records without a facility code give no facility
    node but still their district; a code with several names shows the smallest.
    """
    df = _units(df, facilities, ())
    have, unknown, none = set(df.columns), quoted(L.UNKNOWN_AREA), "CAST(NULL AS STRING)"

    def text(c: str) -> str:
        return f"nullif({strip(c)}, '')" if c in have else none

    names = df.selectExpr(
        f"coalesce({text('pvname')}, {unknown}) AS pvname", f"coalesce({text('ampname')}, {unknown}) AS ampname",
        f"{text('hoscode')} AS code", f"{text('hosname')} AS name").distinct()

    def node(level: str, amp: str, code: str, name: str) -> str:
        return f"struct('{level}' AS level, pvname, {amp} AS ampname, {code} AS code, {name} AS name)"

    nodes = ", ".join([
        node("province", none, none, none),
        node("district", "ampname", none, none),
        f"IF(code IS NULL, NULL, {node('facility', 'ampname', 'code', 'coalesce(name, code)')})",
    ])
    return (
        names.selectExpr(f"explode(array({nodes})) AS n").where("n IS NOT NULL").selectExpr("n.*")
        .groupBy("level", "pvname", "ampname", "code").agg(F.min("name").alias("name"))
        .orderBy("pvname", F.col("ampname").asc_nulls_first(), F.col("name").asc_nulls_first(), "code")
    )


def distinct_values(df: DataFrame, *columns: str, facilities: DataFrame | None = None) -> DataFrame:
    """Distinct combinations of the given columns; given the facilities, records need no area columns."""
    return _units(df, facilities, columns).select(*columns).distinct()
