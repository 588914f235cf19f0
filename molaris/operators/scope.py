"""Which rows count: area, scope of the report, quality, follow-up groups.

Predicates are SQL text, so they can be filters, flags or parts of an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from molaris.functions.rules import met
from molaris.functions.sql import quoted, quoted_list
from molaris.plans.labels import NO_REASON, REASON_SEPARATOR
from molaris.plans.rules import Check, Profile, Table


def filter_area(df: DataFrame, pv: str | None = None, amp: str | None = None,
                hos: str | None = None) -> DataFrame:
    """Rows of a province, district and/or facility; each part is optional."""
    for column, value in (("pvname", pv), ("ampname", amp), ("hoscode", hos)):
        if value:
            df = df.where(F.col(column) == value)
    return df


def in_scope(profile: Profile) -> str:
    """Examined, meets the row filter, age within the profile; never null."""
    return (f"coalesce(examined AND age BETWEEN {profile.age_min} AND {profile.age_max}, false) "
            f"AND {met(profile.row_filter)}")


def scope(df: DataFrame, profile: Profile) -> DataFrame:
    """The examined population of the profile's age group."""
    return df.where(in_scope(profile))


def qualified(profile: Profile) -> str:
    """Base quality rule and the extra rules of the row's band.

    Three-valued on purpose: a row in no band that meets the base rule but not an extra
    rule is null, that is neither qualified nor failed.
    """
    parts = [met(profile.quality_filter)]
    if profile.bands:
        parts += [f"(NOT (band = {quoted(label)}) OR {met(rule)})" for label, rule in profile.quality_extra]
    return "(" + " AND ".join(parts) + ")"


def check_applies(profile: Profile, check: Check) -> str:
    """Does the check concern this row? Checks without bands concern every row."""
    if not check.bands or not profile.bands:
        return "true"
    return f"coalesce(band IN {quoted_list(check.bands)}, false)"


def check_failed(profile: Profile, check: Check) -> str:
    """Applies and is not met; a null result counts as a failure."""
    return f"({check_applies(profile, check)} AND NOT {met(check.rule)})"


def denominator(profile: Profile, table: Table) -> str:
    """Rows of the scope that form the base of a table."""
    if table.denominator == "qualified":
        return qualified(profile)
    if table.denominator in ("examined", "all"):
        return "true"
    return met(table.denominator)


def pending(df: DataFrame) -> DataFrame:
    """Not examined, whatever the age."""
    return df.where("NOT coalesce(examined, false)")


def failed(df: DataFrame, profile: Profile) -> DataFrame:
    """In scope, but not of the required quality."""
    return scope(df, profile).where(f"NOT {qualified(profile)}")


def fail_reason(profile: Profile) -> str:
    """Names of the failed checks in check order; a fixed text when none failed."""
    names = [f"CASE WHEN {check_failed(profile, c)} THEN {quoted(c.name)} END"
             for c in profile.quality_checks]
    joined = f"concat_ws({', '.join([quoted(REASON_SEPARATOR), *names])})"
    return f"coalesce(nullif({joined}, ''), {quoted(NO_REASON)})"
