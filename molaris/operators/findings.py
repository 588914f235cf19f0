"""Findings: sentences drawn by rule from the report, for every area at once.

All work is keyed by (area, table); such a group holds the rows and metrics of one table,
a number fixed by the rule set, so collecting it into an array is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from molaris.functions.numeric import shown
from molaris.functions.sql import labelled, name as column_name, quoted, quoted_list, sentence
from molaris.operators.cells import AREA_KEYS
from molaris.operators.report import CHECK, METRIC, PASS
from molaris.plans import labels as L
from molaris.plans.rules import COUNT_PCT, QUALITY, Profile

_KEYS = ["level", *AREA_KEYS, "table_ord", "table_no", "kind"]


def higher_is_better(metric: str) -> str:
    return "(" + " OR ".join(f"contains({metric}, {quoted(w)})" for w in L.HIGHER_IS_BETTER) + ")"


def primary_metrics(profile: Profile) -> dict[str, str]:
    """Table number to the metric its story is told with: the first one that carries a
    primary word, else the first."""
    chosen = {}
    for table in profile.tables:
        names = [metric.name for metric in table.metrics]
        if names:
            hits = [n for n in names if any(w in n for w in L.PRIMARY_WORDS)]
            chosen[table.no] = (hits or names)[0]
    return chosen


def _is_primary(profile: Profile) -> str:
    tests = [f"role = '{PASS}'"] + [f"(table_no = {quoted(no)} AND metric = {quoted(metric)})"
                                    for no, metric in primary_metrics(profile).items()]
    return "(" + " OR ".join(tests) + ")"


def _tone(value: str) -> str:
    return f"CASE WHEN {value} >= {L.GOOD_FROM} THEN 'good' WHEN {value} >= {L.WARN_FROM} THEN 'warn' ELSE 'bad' END"


def _finding(code: str, seq: int, tone: str, text: str, when: str,
             item: str = "''", item_ord: str = "-1") -> str:
    return (f"IF({when}, struct('{code}' AS code, {seq} AS seq, {item_ord} AS item_ord, {item} AS item, "
            f"{tone} AS tone, {text} AS text), NULL)")


def compare_to_total(long: DataFrame) -> DataFrame:
    """Each figure beside its table's total figure and the signed gap between the two.

    One exchange on (area, table) serves this window and the groupings after it.
    """
    keys = ", ".join([*_KEYS, "metric_ord"])
    return long.repartition(*_KEYS).selectExpr(
        "*", f"max(IF(is_total, value, NULL)) OVER (PARTITION BY {keys}) AS total_value",
    ).selectExpr("*", "value - total_value AS gap")


def _row_facts(long: DataFrame, profile: Profile) -> DataFrame:
    """One row per report row: its primary figure and the metrics that stand out.

    Where metrics tie, the first one wins.
    """
    low = f"role = '{METRIC}' AND NOT {higher_is_better('metric')}"
    named = "struct(metric, value, gap, n)"
    picks = {
        "standout": f"IF({low} AND NOT _primary AND gap >= {L.MIN_GAP}D, struct(gap, -metric_ord), NULL)",
        "top_problem": f"IF({low} AND value > 0, struct(value, -metric_ord), NULL)",
        "top_cause": f"IF(role = '{CHECK}' AND n > 0, struct(n, -metric_ord), NULL)",
    }
    return (
        compare_to_total(long)
        .selectExpr("*", f"{_is_primary(profile)} AS _primary")
        .groupBy(*_KEYS, "row_ord", "row_label", "is_total")
        .agg(
            *[F.expr(f"max(IF(_primary, {c}, NULL)) AS {c}")
              for c in ("value", "total_value", "gap", "base", "n", "metric")],
            *[F.expr(f"max_by({named}, {rank}) AS {c}") for c, rank in picks.items()],
        )
    )


def _with_words(df: DataFrame, profile: Profile) -> DataFrame:
    """Row name, unit, point word and direction of the primary metric."""
    by_age = [t.no for t in profile.tables if t.row_kind == "age"]
    is_age = f"table_no IN {quoted_list(by_age)}" if by_age else "false"
    percent = f"kind = '{COUNT_PCT}'"
    return df.selectExpr(
        "*",
        f"IF({is_age}, {sentence(L.ROW_OF_AGE, 'row_label')}, {sentence(L.ROW_OF_BAND, 'row_label')}) AS name",
        f"IF({percent}, '%', '') AS unit",
        f"IF({percent}, {quoted(L.POINTS)}, {quoted(L.TEETH)}) AS word",
        f"{higher_is_better('metric')} AS high",
    )


def _quality_line() -> str:
    """Pass rate of one group against the total."""
    side = f"IF(gap > 0, {quoted(L.HIGHER)}, {quoted(L.LOWER)})"
    return (
        f"concat({sentence(L.S_ROW_QUALITY, shown('value'))}, "
        f"IF(abs(gap) >= {L.MIN_GAP}D, {sentence(L.S_ROW_QUALITY_GAP, side, shown('abs(gap)', 1))}, ''), "
        f"IF(base > n, {sentence(L.S_ROW_QUALITY_FAILED, shown('base - n', 0))}, ''))"
    )


def _metric_line() -> str:
    """Primary metric of one group against the total, with the metric that stands out."""
    side = f"IF(better, {quoted(L.BETTER)}, {quoted(L.WORSE)})"
    extra = sentence(L.S_ROW_STANDOUT, "standout.metric", shown("standout.value"), "unit",
                     shown("abs(standout.gap)", 1), "word")
    return (
        f"concat({sentence(L.S_ROW, 'metric', shown('value'), 'unit')}, "
        f"IF(abs(gap) >= {L.MIN_GAP}D, {sentence(L.S_ROW_GAP, side, shown('abs(gap)', 1), 'word')}, ''), "
        f"IF(standout IS NOT NULL, {extra}, ''), "
        f"IF(base < {L.SMALL_BASE}, {sentence(L.S_ROW_SMALL, shown('base', 0))}, ''))"
    )


def _row_findings(facts: DataFrame, profile: Profile) -> DataFrame:
    """Adds ``finding``: the line of each group (not the total) that has a figure."""
    worded = _with_words(facts, profile).selectExpr("*", "IF(high, gap > 0, gap < 0) AS better")
    tone = (f"CASE WHEN base < {L.SMALL_BASE} THEN 'warn' WHEN abs(gap) >= {L.MIN_GAP}D "
            f"THEN IF(better, 'good', 'bad') ELSE 'info' END")
    has = "NOT is_total AND value IS NOT NULL"
    place = {"item": "row_label", "item_ord": "row_ord"}
    quality = _finding("I4", 100, _tone("value"), _quality_line(), f"{has} AND kind = '{QUALITY}'", **place)
    metric = _finding("I12", 100, tone, _metric_line(), f"{has} AND kind <> '{QUALITY}'", **place)
    return worded.selectExpr("*", f"coalesce({quality}, {metric}) AS finding")


def _table_facts(rows: DataFrame) -> DataFrame:
    """One row per (area, table): its total, the series of its groups in order, and the
    first, last, lowest and highest of them (the first wins a tie)."""
    point = "struct(row_ord, value, name)"
    small = sentence(L.S_SMALL_ROW, "name", shown("base", 0))
    is_small = f"NOT is_total AND base > 0 AND base < {L.SMALL_BASE}"
    has = "NOT is_total AND value IS NOT NULL"
    grouped = rows.groupBy(*_KEYS).agg(
        F.expr("max(IF(is_total, struct(value, base, n, metric, top_cause, top_problem, unit, word, high), NULL)) AS t"),
        F.expr(f"array_sort(collect_list(IF({has}, {point}, NULL))) AS series"),
        F.expr(f"min_by({point}, IF({has}, struct(value, row_ord), NULL)) AS lowest"),
        F.expr(f"max_by({point}, IF({has}, struct(value, -row_ord), NULL)) AS highest"),
        F.expr(f"array_sort(collect_list(IF({is_small}, struct(row_ord, {small} AS s), NULL))) AS small"),
        F.expr("collect_list(finding) AS row_findings"),
    )
    steps = ("transform(slice(series, 2, greatest(size(series) - 1, 0)), (b, i) -> struct("
             "b.value - get(series, i).value AS value, i AS i, get(series, i).name AS before, b.name AS after))")
    return grouped.selectExpr(
        *_KEYS, "t.*", "series", "lowest", "highest", "small", "row_findings",
        "get(series, 0) AS first", "get(series, size(series) - 1) AS last", f"{steps} AS steps",
    ).selectExpr(
        "*", "last.value - first.value AS change",
        "IF(high, lowest, highest) AS worst", "IF(high, highest, lowest) AS best",
        "IF(high, array_min(steps), array_max(transform(steps, s -> "
        "struct(s.value AS value, -s.i AS i, s.before AS before, s.after AS after)))) AS step",
    ).selectExpr("*", "IF(high, change < 0, change > 0) AS worse", "IF(high, step.value < 0, step.value > 0) AS step_worse")


def _quality_summary() -> list[str]:
    quality = f"kind = '{QUALITY}'"
    share = "100D * top_cause.n / nullif(base - n, 0)"
    return [
        _finding("I1", 1, _tone("coalesce(value, 0D)"), sentence(
            L.S_QUALITY, shown("value"), shown("n", 0), shown("base", 0), shown("base - n", 0)), quality),
        _finding("I2", 2, "'warn'", sentence(
            L.S_QUALITY_RANGE, "lowest.name", shown("lowest.value"), "highest.name", shown("highest.value"),
            shown("highest.value - lowest.value", 1)),
            f"{quality} AND highest.value - lowest.value >= {L.MIN_GAP}D"),
        _finding("I3", 3, "'bad'",
                 f"concat({sentence(L.S_CAUSE, 'top_cause.metric', shown('top_cause.n', 0))}, "
                 f"IF(base > n, {sentence(L.S_CAUSE_SHARE, shown(share, 0))}, ''), {quoted(L.S_CAUSE_HINT)})",
                 f"{quality} AND top_cause IS NOT NULL"),
    ]


def _metric_summary() -> list[str]:
    told = f"kind <> '{QUALITY}' AND size(series) > 0"
    return [
        _finding("I6", 1, "'info'", sentence(L.S_OVERALL, "metric", shown("value"), "unit"),
                 f"{told} AND value IS NOT NULL"),
        _finding("I7", 2, "IF(worse, 'bad', 'good')", sentence(
            L.S_TREND, "metric", shown("first.value"), "unit", "first.name", shown("last.value"), "unit",
            "last.name", f"IF(change < 0, {quoted(L.FELL)}, {quoted(L.ROSE)})", shown("abs(change)", 1), "word",
            f"IF(worse, {quoted(L.OLDER_IS_WORSE)}, {quoted(L.OLDER_IS_BETTER)})"),
            f"{told} AND abs(change) >= {L.MIN_GAP}D"),
        _finding("I8", 3, "'warn'", sentence(
            L.S_FOCUS, "worst.name", "metric", shown("worst.value"), "unit",
            f"IF(high, {quoted(L.LOWEST)}, {quoted(L.HIGHEST)})", "best.name", shown("best.value"), "unit"),
            f"{told} AND worst.row_ord <> best.row_ord"),
        _finding("I9", 4, "'warn'", sentence(
            L.S_STEP, "step.before", "step.after", shown("abs(step.value)", 1), "word"),
            f"{told} AND size(series) >= 3 AND step_worse AND abs(step.value) >= {L.MIN_GAP}D"),
        _finding("I10", 5, "'info'", sentence(L.S_TOP, "top_problem.metric", shown("top_problem.value"), "unit"),
                 f"{told} AND top_problem IS NOT NULL AND top_problem.metric <> metric"),
        _finding("I11", 6, "'warn'", f"concat({quoted(L.S_SMALL)}, array_join(transform(small, r -> r.s), ', '))",
                 f"{told} AND size(small) > 0"),
    ]


def findings(long: DataFrame, profile: Profile) -> DataFrame:
    """Findings of every table and area in the long report.

    Columns: area, table, ``code`` (which finding), ``item`` (the row, empty for a summary),
    ``tone`` and ``text``; ``seq`` and ``item_ord`` give the order within a table.
    """
    tables = _table_facts(_row_findings(_row_facts(long, profile), profile))
    summary = ", ".join([*_quality_summary(), *_metric_summary()])
    every = f"concat(filter(array({summary}), f -> f IS NOT NULL), row_findings)"
    return tables.selectExpr(*_KEYS, f"explode({every}) AS f").selectExpr(*_KEYS, "f.*")


def findings_table(found: DataFrame, profile: Profile, with_area: bool = False) -> DataFrame:
    """Findings as one flat table (table, level, item, status, text) in report order."""
    areas = ["level", *AREA_KEYS] if with_area else []
    titles = {k: column_name(v) for k, v in L.FINDING_COLUMNS.items()}
    empty = {k: "'-'" for k in titles} | {"text": quoted(L.NO_FINDINGS)}
    none = [f"CAST(NULL AS STRING) AS {a}" for a in areas]
    placeholder = [*none, *[f"{empty[k]} AS {t}" for k, t in titles.items()]]
    if not profile.tables:
        return found.sparkSession.range(0, 1, 1, 1).selectExpr(*placeholder)
    heads = {t.no: L.TABLE_HEAD % (t.no, t.title) for t in profile.tables}
    rows = {t.no: L.ROW_LABELS[t.row_kind] for t in profile.tables}
    shown_as = {
        "table": labelled("table_no", heads),
        "level": f"IF(item = '', {quoted(L.SUMMARY_LEVEL)}, {labelled('table_no', rows)})",
        "item": "item",
        "status": labelled("tone", L.TONE_LABELS, "''"),
        "text": "text",
    }
    rows = found.orderBy(*areas, "table_ord", "seq", "item_ord").selectExpr(
        *areas, *[f"{shown_as[k]} AS {t}" for k, t in titles.items()])
    # a report without findings says so in one row
    return rows.union(found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").selectExpr(*placeholder))
