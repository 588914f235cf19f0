"""Plain values that describe one report (a rule set for one age group)."""

from __future__ import annotations

from dataclasses import dataclass

from molaris.functions.rules import Rule

QUALITY, COUNT_PCT, MEAN = "quality", "count_pct", "mean"
TABLE_KINDS = (QUALITY, COUNT_PCT, MEAN)


@dataclass(frozen=True)
class Metric:
    name: str
    rule: Rule


@dataclass(frozen=True)
class Check:
    """One quality check; with ``bands`` it applies to rows of those bands only."""

    name: str
    rule: Rule
    bands: tuple[str, ...] = ()


@dataclass(frozen=True)
class Band:
    label: str
    min: int
    max: int


@dataclass(frozen=True)
class Table:
    """``rows``: age, band/bands, or anything else for the total row alone.

    ``denominator``: qualified, examined, all (every row in scope), or a rule.
    """

    no: str
    title: str
    kind: str
    rows: str = "age"
    denominator: str = "qualified"
    metrics: tuple[Metric, ...] = ()
    conditions: tuple[str, ...] = ()
    decimals: int = 2

    def __post_init__(self) -> None:
        if self.kind not in TABLE_KINDS:
            raise ValueError(f"unknown table kind: {self.kind}")

    @property
    def row_kind(self) -> str:
        return {"age": "age", "band": "band", "bands": "band"}.get(self.rows, "none")


@dataclass(frozen=True)
class NameRule:
    contains: str
    value: str


@dataclass(frozen=True)
class NameColumn:
    """A column filled from the name of the source file, first matching rule wins."""

    column: str
    rules: tuple[NameRule, ...]
    default: str | None = None
    overwrite: bool = False


@dataclass(frozen=True)
class Overview:
    """Metrics of the area breakdown; the defaults look at permanent teeth."""

    caries_free: Rule = "pcaries + pfilling + pextract = 0"
    dmft: Rule = "pcaries + pfilling + pextract"
    caries_free_label: str = "ปราศจากฟันผุ"
    dmft_label: str = "DMFT เฉลี่ย"


@dataclass(frozen=True)
class Profile:
    """``quality_extra``: (band label, rule) pairs required on top of the quality rule."""

    id: str
    label: str
    age_min: int
    age_max: int
    quality_filter: Rule
    tables: tuple[Table, ...]
    row_filter: Rule = None
    quality_checks: tuple[Check, ...] = ()
    bands: tuple[Band, ...] = ()
    quality_extra: tuple[tuple[str, str], ...] = ()
    overview: Overview = Overview()
    filename_columns: tuple[NameColumn, ...] = ()

    def table(self, no: str) -> Table:
        for t in self.tables:
            if t.no == str(no):
                return t
        raise KeyError(f"profile {self.id} has no table {no}")
