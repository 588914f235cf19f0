"""Bring raw records into one shape: headers, blanks, numbers, dates, codes."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from molaris.functions import arrow_text, sql, text
from molaris.plans.labels import CODE_COLUMNS, NUMERIC_COLUMNS, TIME_COLUMNS  # noqa: F401
from molaris.plans.rules import NameColumn

SOURCE_FILE = "_source_file"


def tidy_headers(df: DataFrame) -> DataFrame:
    """Trim and lower-case the column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _stripped(column: str, kind: str) -> str:
    """First step: text without outer white space, blank tokens of text columns as null."""
    c = sql.name(column)
    if column.startswith("_") or kind != "string" and column in NUMERIC_COLUMNS + TIME_COLUMNS:
        return c
    if column in NUMERIC_COLUMNS + TIME_COLUMNS:
        return text.strip(c)
    return text.blank_to_null(c if kind == "string" else f"CAST({c} AS STRING)")


def _typed(column: str, kind: str, layouts: Sequence[str]) -> str:
    """Second step: numbers and times."""
    c = sql.name(column)
    if column in NUMERIC_COLUMNS:
        return text.to_number(c) if kind == "string" else f"nanvl(CAST({c} AS DOUBLE), NULL)"
    if column in TIME_COLUMNS:
        return text.to_time(c, layouts) if kind == "string" else f"CAST({c} AS TIMESTAMP_NTZ)"
    return c


def cleaned_kind(column: str) -> str:
    """Type of a text column after ``cleaned_values``."""
    return "double" if column in NUMERIC_COLUMNS else "string"


def cleaned_values(column: str, values: pa.Array) -> pa.Array:
    """What ``conform`` makes of a text column, but for times, which are only stripped."""
    if column.startswith("_"):
        return values
    if column in NUMERIC_COLUMNS:
        return arrow_text.to_number(arrow_text.strip(values))
    return arrow_text.strip(values) if column in TIME_COLUMNS else arrow_text.blank_to_null(values)


def conform(df: DataFrame, layouts: Sequence[str] = (), cleaned: bool = False) -> DataFrame:
    """Tidy headers, null the blank tokens, type the known columns, keep the rest as text.

    Text and typed columns are both accepted. Columns whose name starts with ``_`` are left
    alone. ``layouts`` are further date patterns, tried in their order. Narrow projections: each strips, parses or
    checks a column once, so that none grows too large to be compiled. ``cleaned`` says that all columns went through
    ``cleaned_values``, which leaves the times.
    """
    df = tidy_headers(df)
    kinds = dict(df.dtypes)
    stripped = df if cleaned else df.selectExpr(*[f"{_stripped(c, k)} AS {sql.name(c)}" for c, k in kinds.items()])
    typed = stripped.selectExpr(*[f"{_typed(c, k, layouts)} AS {sql.name(c)}" for c, k in kinds.items()])
    return typed.selectExpr(*[
        f"{text.valid_time(sql.name(c))} AS {sql.name(c)}" if c in TIME_COLUMNS else sql.name(c) for c in kinds])


def unparsed(df: DataFrame, layouts: Sequence[str] = ()) -> DataFrame:
    """(column, values): how many values of each numeric and date column are neither blank nor understood."""
    df = tidy_headers(df)
    typed = [c for c, k in df.dtypes if k == "string" and c in NUMERIC_COLUMNS + TIME_COLUMNS]
    both = df.selectExpr(*[f"{text.blank_to_null(sql.name(c))} AS {sql.name(c)}" for c in typed],
                         *[f"{text.strip(sql.name(c))} AS {sql.name('_' + c)}" for c in typed])
    read = {c: text.to_number(sql.name("_" + c)) if c in NUMERIC_COLUMNS else
            text.valid_time(text.to_time(sql.name("_" + c), layouts)) for c in typed}
    counts = both.agg(*[F.expr(f"count_if({sql.name(c)} IS NOT NULL AND {x} IS NULL) AS {sql.name(c)}") for c, x in read.items()])
    pairs = ", ".join(f"'{c}', {sql.name(c)}" for c in typed)
    return counts.selectExpr(f"stack({len(typed)}, {pairs}) AS (column, values)")


def name_value(spec: NameColumn) -> str:
    """Value the file-name rules give: first literal, case-insensitive hit, else the default."""
    source = f"lower(coalesce({SOURCE_FILE}, ''))"
    hits = " ".join(
        f"WHEN contains({source}, {sql.quoted(rule.contains.lower())}) THEN {sql.quoted(rule.value)}"
        for rule in spec.rules
        if rule.contains
    )
    default = sql.quoted(spec.default)
    return f"CASE {hits} ELSE {default} END" if hits else default


def add_name_columns(df: DataFrame, specs: Sequence[NameColumn]) -> DataFrame:
    """Columns from the source file's name; an existing column is only filled where blank."""
    if SOURCE_FILE not in df.columns:
        return df
    for spec in specs:
        value = name_value(spec)
        if spec.column in df.columns and not spec.overwrite:
            value = f"coalesce(CAST({sql.name(spec.column)} AS STRING), {value})"
        df = df.withColumn(spec.column, F.expr(value))
    return df
