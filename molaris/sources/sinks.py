"""Write report parts as CSV or Parquet.

A bundle is written to a folder of its own below its path, its list of parts last. Readers take the newest bundle whose
list of parts is there, so a failure, or a writer at work, leaves them the whole bundle before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from molaris.operators.areas import breakdown, headline
from molaris.operators.cells import report_rows
from molaris.operators.export import breakdown_table, header_table, notes_table
from molaris.operators.findings import findings, findings_table
from molaris.operators.report import long_report, wide_table
from molaris.operators.scope import filter_area
from molaris.plans.rules import Profile
from molaris.sources.storage import drop_folder, folders_named, is_complete

# Bundles below a path that stay: the newest and the one before, which may still be read.
KEPT = 2
PARTS = "parts"


def write_csv(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """CSV with a header line, UTF-8 without byte-order mark; numbers keep their text form."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", "").partitionBy(*partition_by).csv(path)


def write_bundle(cells: DataFrame, profile: Profile, path: str, as_of: str, fmt: str = "parquet",
                 levels: Iterable[str] = ("all",), pv: str | None = None, amp: str | None = None,
                 hos: str | None = None) -> list[str]:
    """The whole report below ``path``: header, findings, breakdown, each table, and the notes under the tables.

    ``cells`` come from ``build_cells``. They and the rolled-up rows are written first and read back, so the records are
    scanned once whatever the number of parts. A selected province, district or facility narrows the cells. The
    breakdown drills down: districts, then the units of a selected district, none below a facility. The bundle counts
    once all parts are written; the one before stays. Returns the names of the parts.
    """
    levels, spark, top = list(levels), cells.sparkSession, path.rstrip("/")
    done = bundles(spark, top)
    path = f"{top}/bundle_{int(done[-1].split('_')[1]) + 1 if done else 1:06d}_{uuid.uuid4().hex}"
    cells = _kept(filter_area(cells, pv, amp, hos), f"{path}/cells")
    rows = _kept(report_rows(cells, profile, levels), f"{path}/rows")
    with_area = levels != ["all"]
    parts = {
        "header": header_table(headline(cells, profile, levels), profile, as_of, tuple(a for a in (pv, amp, hos) if a)),
        "findings": findings_table(findings(long_report(rows, profile), profile), profile, with_area),
    }
    if not amp and not hos:
        parts["districts"] = breakdown_table(breakdown(cells, profile, "district"), profile, "district")
    elif not hos:
        parts["units"] = breakdown_table(breakdown(cells, profile, "unit"), profile, "unit")
    for table in profile.tables:
        parts[f"table_{table.no}"] = wide_table(rows, profile, table.no, with_area)
    parts["notes"] = notes_table(cells.sparkSession, profile)
    for name, part in parts.items():
        if fmt == "csv":
            write_csv(part, f"{path}/{name}")
        else:
            part.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
    spark.createDataFrame([(n, fmt) for n in parts], "part string, format string").coalesce(1).write.parquet(f"{path}/{PARTS}")
    for old in bundles(spark, top)[:-KEPT]:
        drop_folder(spark, f"{top}/{old}")
    return list(parts)


def bundles(spark: SparkSession, path: str) -> list[str]:
    """The folders of the finished bundles of a path, oldest first."""
    top = path.rstrip("/")
    return [n for n in sorted(folders_named(spark, top, r"bundle_\d{6}_[0-9a-f]{32}")) if is_complete(spark, f"{top}/{n}/{PARTS}")]


def read_part(spark: SparkSession, path: str, name: str, fmt: str = "parquet", bundle: str | None = None) -> DataFrame:
    """One part of a written report by name, such as ``table_2`` or ``findings``. To read several parts of one report
    while others may be written, name the ``bundle``, the last of ``bundles``."""
    done = [bundle] if bundle else bundles(spark, path)
    if not done:
        raise FileNotFoundError(f"no finished bundle in {path}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(f"{path.rstrip('/')}/{done[-1]}/{name}")


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
