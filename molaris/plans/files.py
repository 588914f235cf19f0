"""Rule sets from files, so that an age group is added or changed without code."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from molaris.functions import rule_language
from molaris.functions.rule_language import RuleError, kinds_of
from molaris.plans.rules import Band, Check, Metric, NameColumn, NameRule, Overview, Profile, Table


class ProfileError(ValueError):
    """A rule-set file that cannot be used."""


def _parsed(content: str, path: str) -> dict[str, Any]:
    if path.lower().endswith(".json"):
        return json.loads(content)
    try:
        import yaml
    except ImportError as e:
        raise ProfileError(f"{path}: reading YAML needs a YAML library; JSON does not") from e
    return yaml.safe_load(content)


Compile = Callable[[Any], Any]


def _table(spec: dict[str, Any], to_sql: Compile) -> Table:
    return Table(
        no=str(spec["no"]), title=str(spec.get("title", "")), kind=spec.get("kind", "count_pct"), rows=spec.get("rows", "age"),
        denominator=_denominator(spec.get("denominator", "qualified"), to_sql),
        metrics=tuple(Metric(str(m["name"]), to_sql(m.get("expr"))) for m in spec.get("metrics") or ()),
        conditions=tuple(str(c) for c in spec.get("conditions") or ()), decimals=int(spec.get("decimals", 2)),
    )


def _denominator(value: str, to_sql: Compile) -> str:
    return value if value in ("qualified", "examined", "all") else to_sql(value)


def profile_of(spec: dict[str, Any], path: str = "rule set", records: DataFrame | None = None) -> Profile:
    """A rule set from its description; raises ``ProfileError`` naming the file if something is wrong.

    With prepared ``records``, rules are compiled by the types of their columns, and a column they do not have is wrong.
    """
    kinds = None if records is None else kinds_of(records.dtypes)

    def to_sql(rule: Any) -> Any:
        return rule_language.to_sql(rule, kinds)

    try:
        low, high = spec["age_range"]
        overview = spec.get("overview") or {}
        rules = {k: to_sql(overview[k]) for k in ("caries_free", "dmft") if k in overview}
        labels = {k: str(overview[k]) for k in ("caries_free_label", "dmft_label") if k in overview}
        return Profile(
            id=str(spec["id"]), label=str(spec.get("label", spec["id"])), age_min=int(low), age_max=int(high),
            quality_filter=to_sql(spec["quality_filter"]), row_filter=to_sql(spec.get("row_filter")),
            tables=tuple(_table(t, to_sql) for t in spec.get("tables") or ()),
            quality_checks=tuple(
                Check(str(c["name"]), to_sql(c.get("expr")), tuple(str(b) for b in c.get("bands") or ()))
                for c in spec.get("quality_checks") or ()),
            bands=tuple(Band(str(b["label"]), int(b["min"]), int(b["max"])) for b in spec.get("bands") or ()),
            quality_extra=tuple((str(k), to_sql(v)) for k, v in (spec.get("quality_extra") or {}).items()),
            overview=Overview(**rules, **labels),
            filename_columns=tuple(
                NameColumn(c["column"], tuple(NameRule(str(r["contains"]), str(r["value"])) for r in c.get("rules") or ()),
                           c.get("default"), bool(c.get("overwrite", False)))
                for c in spec.get("filename_columns") or ()),
        )
    except KeyError as e:
        raise ProfileError(f"{path}: {e.args[0]} is missing") from None
    except (RuleError, TypeError, ValueError) as e:
        raise ProfileError(f"{path}: {e}") from None


def read_profiles(spark: SparkSession, folder: str, records: DataFrame | None = None) -> dict[str, Profile]:
    """The rule sets of a folder (or one file) by id, in order of their paths. Files without an id are skipped.
    ``records`` as in ``profile_of``."""
    found = spark.read.option("pathGlobFilter", "*.{yaml,yml,json}").text(folder, wholetext=True)
    files = sorted(found.selectExpr("_metadata.file_path AS path", "value").collect())
    out: dict[str, Profile] = {}
    for path, content in files:
        spec = _parsed(content, path)
        if spec and spec.get("id"):
            out[str(spec["id"])] = profile_of(spec, path, records)
    return out
