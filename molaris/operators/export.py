"""Report parts as labelled tables, ready for a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from molaris.functions import sql
from molaris.operators.cells import AREA_KEYS
from molaris.plans import labels as L
from molaris.plans.rules import Profile


def breakdown_table(breakdown: DataFrame, profile: Profile, by: str = "district") -> DataFrame:
    """Area breakdown with the profile's headings."""
    unit = L.DISTRICT_WORD if by == "district" else L.UNIT_WORD
    return breakdown.select(
        F.col("code").alias(L.CODE_WORD + unit),
        F.col("name").alias(unit),
        *[F.col(c).alias(title) for c, title in L.BREAKDOWN_COLUMNS],
        F.col("caries_free_pct").alias("%" + profile.overview.caries_free_label),
        F.col("dmft").alias(profile.overview.dmft_label),
    )


def header_table(headline: DataFrame, profile: Profile, as_of: str, area: tuple[str, ...] = ()) -> DataFrame:
    """Report header: twelve label and value rows per area of the headline.

    ``area`` names the filter the report was made with; a drill-down row names itself.
    """
    given = L.HEADER_AREA_SEPARATOR.join(a for a in area if a) or L.HEADER_ALL_AREAS
    own = f"nullif(concat_ws({sql.quoted(L.HEADER_AREA_SEPARATOR)}, {', '.join(AREA_KEYS)}), '')"
    known = {
        "label": sql.quoted(profile.label),
        "area": f"coalesce({own}, {sql.quoted(given)})",
        "as_of": sql.quoted(as_of),
    }
    rows = ", ".join(
        f"struct({i} AS ord, {sql.quoted(title)} AS item, CAST({known.get(key, key)} AS STRING) AS value)"
        for i, (key, title) in enumerate(L.HEADER_ROWS))
    areas = ["level", *AREA_KEYS]
    return headline.selectExpr(*areas, f"explode(array({rows})) AS r").orderBy(*areas, "r.ord").selectExpr(
        *areas, "r.ord AS ord", f"r.item AS {sql.name(L.HEADER_ITEM)}", f"r.value AS {sql.name(L.HEADER_VALUE)}")


def notes_table(spark: SparkSession, profile: Profile) -> DataFrame:
    """Title and conditions of each table, in order."""
    rows = [(t.no, i, note) for t in profile.tables for i, note in enumerate([L.TABLE_HEAD % (t.no, t.title), *t.conditions])]
    return spark.createDataFrame(rows, "table_no string, ord int, note string")
