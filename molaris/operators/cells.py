"""One pass over the records: additive measures per facility and report row.

Everything a report shows (tables, headline, breakdowns, every drill-down level) is a
sum, minimum or maximum of these cells, so the records are scanned and shuffled once,
with map-side combining, and all later steps work on the small cell table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from molaris.functions.rules import Rule, amount, met
from molaris.functions.sql import name as column_name
from molaris.functions.text import strip
from molaris.operators.derive import band_number
from molaris.operators.lookup import attach_area
from molaris.operators.scope import check_applies, check_failed, denominator, in_scope, qualified
from molaris.plans.rules import COUNT_PCT, MEAN, QUALITY, Check, Profile, Table

AREA_KEYS = ["pvname", "ampname", "hoscode"]
NAME_KEYS = ["ampcode", "hosname"]

# Drill-down levels: the area columns that are fixed, the others are rolled up.
LEVELS: dict[str, tuple[str, ...]] = {
    "all": (),
    "province": ("pvname",),
    "district_name": ("ampname",),
    "district": ("pvname", "ampname"),
    "facility_code": ("hoscode",),
    "facility": ("pvname", "ampname", "hoscode"),
}

TOTAL = "total"


class Measures:
    """The measures a profile needs, each computed once however many tables show it.

    ``aggregates`` maps a short column name to its aggregate as SQL text.
    """

    def __init__(self, profile: Profile):
        self.profile = profile
        self._bases: dict[str, str] = {}
        self._names: dict[tuple, str] = {}
        self.aggregates: dict[str, str] = {}
        self.target = self._add(("target",), "count(1)")
        self.pending = self._add(("pending",), "count_if(NOT coalesce(examined, false))")
        all_examined = Table("", "", COUNT_PCT, denominator="examined")
        all_qualified = Table("", "", COUNT_PCT, denominator="qualified")
        self.examined = self.base(all_examined)
        self.qualified = self.base(all_qualified)
        self.caries_free = self.count(all_qualified, profile.overview.caries_free)
        self.dmft = self.total(all_qualified, profile.overview.dmft)
        for table in profile.tables:
            if table.kind == QUALITY:
                for check in profile.quality_checks:
                    self.fails(check)
                    self.applies(check)
            else:
                self.base(table)
                for metric in table.metrics:
                    (self.total if table.kind == MEAN else self.count)(table, metric.rule)

    def _add(self, key: tuple, aggregate: str) -> str:
        if key not in self._names:
            name = f"m{len(self._names)}"
            self._names[key] = name
            self.aggregates[name] = aggregate
        return self._names[key]

    def _base_flag(self, table: Table) -> str:
        if table.denominator in ("examined", "all"):
            return "_in_scope"
        if table.denominator not in self._bases:
            self._bases[table.denominator] = denominator(self.profile, table)
        return f"_base{list(self._bases).index(table.denominator)}"

    def base(self, table: Table) -> str:
        flag = self._base_flag(table)
        return self._add(("base", flag), f"count_if({flag})")

    def count(self, table: Table, rule: Rule) -> str:
        flag = self._base_flag(table)
        return self._add(("count", flag, rule), f"count_if({flag} AND {met(rule)})")

    def total(self, table: Table, rule: Rule) -> str:
        flag = self._base_flag(table)
        return self._add(("total", flag, rule),
                         f"coalesce(sum(CASE WHEN {flag} THEN {amount(rule)} END), 0D)")

    def fails(self, check: Check) -> str:
        return self._add(("fails", check), f"count_if(_in_scope AND {check_failed(self.profile, check)})")

    def applies(self, check: Check) -> str:
        return self._add(("applies", check), f"count_if(_in_scope AND {check_applies(self.profile, check)})")

    def flags(self, df: DataFrame) -> DataFrame:
        """The records with one never-null flag column per base."""
        return df.selectExpr("*", f"{in_scope(self.profile)} AS _in_scope").selectExpr(
            "*", *[f"_in_scope AND coalesce({rule}, false) AS _base{i}"
                   for i, rule in enumerate(self._bases.values())])


def row_kinds(profile: Profile) -> set[str]:
    """Kinds of rows the profile's tables need besides the total."""
    return {t.row_kind for t in profile.tables} - {"none"}


def build_cells(df: DataFrame, profile: Profile, facilities: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per (area names, facility, age or band) over the whole population.

    Rows out of scope keep a null age and band, so they count only towards totals.

    Records that already carry their area need no ``facilities``. With them, the records are
    summed by facility code first and only the cells are looked up, so the records are never
    joined; use this when no rule of the profile names a facility column. ``by`` are further columns to keep apart, which
    ``merged_cells`` sums up again.
    """
    m = Measures(profile)
    kinds = row_kinds(profile)
    have = set(df.columns)
    date = "date_serv" if "date_serv" in have else "CAST(NULL AS TIMESTAMP_NTZ)"
    age = "CAST(age AS INT)" if "age" in kinds else "CAST(NULL AS INT)"
    band = band_number(profile) if "band" in kinds else "CAST(NULL AS INT)"
    if facilities is not None:
        df = df.withColumn("hoscode", F.expr(strip("hoscode")))
    flagged = m.flags(df).selectExpr(
        "*",
        f"CASE WHEN _in_scope THEN {age} END AS _age",
        f"CASE WHEN _in_scope THEN {band} END AS _band",
        f"CASE WHEN _in_scope THEN {date} END AS _date",
    )
    keys = [c for c in AREA_KEYS + NAME_KEYS if c in have]
    cells = flagged.groupBy(*keys, *by, "_age", "_band").agg(
        *[F.expr(f"{a} AS {name}") for name, a in m.aggregates.items()],
        F.expr("min(_date) AS date_min"), F.expr("max(_date) AS date_max"))
    if facilities is not None:
        wanted = [c for c in facilities.columns if c in AREA_KEYS + NAME_KEYS]
        cells = attach_area(cells, facilities.select(*wanted))
    have = set(cells.columns)
    missing = [f"CAST(NULL AS STRING) AS {c}" for c in AREA_KEYS + NAME_KEYS if c not in have]
    return cells.selectExpr("*", *missing) if missing else cells


def merged_cells(cells: DataFrame, profile: Profile) -> DataFrame:
    """Cells of several parts of the records as cells of all of them."""
    m = Measures(profile)
    return cells.groupBy(*AREA_KEYS, *NAME_KEYS, "_age", "_band").agg(
        *sum_measures(m), F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"))


def sum_measures(m: Measures) -> list[Column]:
    return [F.expr(f"sum({name}) AS {name}") for name in m.aggregates]


def _null_but(level: str) -> str:
    return ", ".join(f"{k if k in LEVELS[level] else 'CAST(NULL AS STRING)'} AS {k}" for k in AREA_KEYS)


def at_levels(cells: DataFrame, levels: Iterable[str]) -> DataFrame:
    """Each cell once per level, with the rolled-up area columns set to null.

    The facility and district a cell belongs to stay available as ``_hoscode`` and
    ``_ampname``.
    """
    areas = ", ".join(f"struct('{level}' AS level, {_null_but(level)})" for level in levels)
    rest = [column_name(c) for c in cells.columns if c not in AREA_KEYS]
    return cells.selectExpr(
        f"explode(array({areas})) AS _area", "hoscode AS _hoscode", "ampname AS _ampname", *rest,
    ).selectExpr("_area.*", "_hoscode", "_ampname", *rest)


def _slot(kind: str, number: str) -> str:
    return f"struct('{kind}' AS row_kind, {number} AS row_ord)"


def _spine(profile: Profile) -> list[str]:
    """Every row a table of the profile must show, empty or not."""
    kinds = row_kinds(profile)
    slots = []
    if "age" in kinds:
        slots += [_slot("age", str(a)) for a in range(profile.age_min, profile.age_max + 1)]
    if "band" in kinds:
        slots += [_slot("band", str(i)) for i in range(len(profile.bands))]
    return slots


def report_rows(cells: DataFrame, profile: Profile, levels: Iterable[str] = ("all",)) -> DataFrame:
    """Measures per level, area and report row, with total rows and empty rows in place.

    Cells are summed into their own row and the total of their area. Each total then puts
    down a zero for every row of the spine and a second sum merges them in: the spine needs
    no join, and the second sum only sees rolled-up rows.
    """
    m = Measures(profile)
    levels = list(levels)
    keys = ["level", *AREA_KEYS, "row_kind", "row_ord"]
    own_slots = ", ".join([_slot("age", "_age"), _slot("band", "_band"), _slot(TOTAL, "0")])
    rolled = (
        at_levels(cells, levels)
        .selectExpr("level", *AREA_KEYS,
                    f"explode(filter(array({own_slots}), s -> s.row_ord IS NOT NULL)) AS _slot",
                    *m.aggregates)
        .selectExpr("level", *AREA_KEYS, "_slot.*", *m.aggregates)
        .groupBy(*keys).agg(*sum_measures(m))
    )
    zero = {f.name: f"CAST(0 AS {f.dataType.simpleString()})" for f in cells.schema.fields}
    if "all" in levels:
        # The whole population has its rows even when there is no record at all.
        empty = cells.sparkSession.range(0, 1, 1, 1).selectExpr(
            "'all' AS level", *[f"CAST(NULL AS STRING) AS {k}" for k in AREA_KEYS],
            f"'{TOTAL}' AS row_kind", "0 AS row_ord", *[f"{zero[c]} AS {c}" for c in m.aggregates])
        rolled = rolled.unionByName(empty)
    spine = ", ".join(["struct(row_kind, row_ord)", *_spine(profile)])
    return (
        rolled.selectExpr(
            "*", f"explode(IF(row_kind = '{TOTAL}', array({spine}), array(struct(row_kind, row_ord)))) AS _to")
        .selectExpr(
            "level", *AREA_KEYS, "_to.row_kind AS row_kind", "_to.row_ord AS row_ord",
            *[f"IF(_to.row_kind = row_kind AND _to.row_ord = row_ord, {c}, {zero[c]}) AS {c}"
              for c in m.aggregates])
        .groupBy(*keys).agg(*sum_measures(m))
    )
