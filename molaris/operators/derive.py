"""Derived columns every rule set can use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from molaris.functions.dates import months_between, years_between
from molaris.functions.gum import GUM_CODES, gum_label, gum_status, normal_gum, sextants
from molaris.functions.sql import quoted
from molaris.functions.text import strip
from molaris.plans.rules import Profile

PERMANENT_INDEX = ["pcaries", "pfilling", "pextract"]
MILK_INDEX = ["dcaries", "dfilling", "dextract"]


def index_sum(columns: list[str]) -> str:
    """Row sum with null as 0; null only when every part is null."""
    total = " + ".join(f"coalesce({c}, 0D)" for c in columns)
    return f"CASE WHEN coalesce({', '.join(columns)}) IS NOT NULL THEN {total} END"


def _band_case(profile: Profile, age: str, results: list[str], kind: str) -> str:
    cases = " ".join(f"WHEN {age} BETWEEN {b.min} AND {b.max} THEN {r}"
                     for b, r in zip(profile.bands, results))
    return f"CAST(CASE {cases} END AS {kind})" if cases else f"CAST(NULL AS {kind})"


def band_number(profile: Profile, age: str = "age") -> str:
    """Position of the first band that holds the age; null outside all bands."""
    return _band_case(profile, age, [str(i) for i in range(len(profile.bands))], "INT")


def band_label(profile: Profile, age: str = "age") -> str:
    """Label of the first band that holds the age; null outside all bands."""
    return _band_case(profile, age, [quoted(b.label) for b in profile.bands], "STRING")


def prepare(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Age, examined flag, gum codes, caries indices and, with a profile, the age band.

    Missing inputs degrade: no dates give a null age, no service date means not examined,
    no gum column gives null gum columns. Narrow projections only.
    """
    have = set(df.columns)
    dated = {"date_serv", "birth"} <= have
    added = {
        "age": years_between("birth", "date_serv") if dated else "CAST(NULL AS INT)",
        "examined": "date_serv IS NOT NULL" if "date_serv" in have else "false",
        "_gum": strip("gum") if "gum" in have else "CAST(NULL AS STRING)",
    }
    if dated:
        added["age_month"] = months_between("birth", "date_serv")
    if set(PERMANENT_INDEX) <= have:
        added["dmft_p"] = index_sum(PERMANENT_INDEX)
    if set(MILK_INDEX) <= have:
        added["dmft_d"] = index_sum(MILK_INDEX)
    first = df.selectExpr(*_kept(df, added), *_aliased(added))
    first = first.selectExpr(*_kept(first, {"_gum": ""}), f"{normal_gum('_gum')} AS _gum")

    coded = {f"gum_sx_{code}": sextants("_gum", code) for code in GUM_CODES}
    coded["gum_status"] = gum_status("_gum")
    if "gum" in have:
        coded["gum_label"] = gum_label(gum_status("_gum"))
    if profile is not None and profile.bands:
        coded["band"] = band_label(profile)
    return first.selectExpr(*[c for c in _kept(first, coded) if c != "`_gum`"], *_aliased(coded))


def _kept(df: DataFrame, added: dict[str, str]) -> list[str]:
    return [f"`{c}`" for c in df.columns if c not in added]


def _aliased(added: dict[str, str]) -> list[str]:
    return [f"{x} AS `{c}`" for c, x in added.items()]
