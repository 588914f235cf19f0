import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, compare
from checks.oracle import ORACLE
from checks.queries import QUERIES
from conftest import SF

KEYS = ["s1_folder_scan", "s2_source_file", "s3_facilities_thai", "n3_numeric", "n4_layouts", "n4_unparsed", "n6_filename_rules",
        "j1_facility_lookup_salted", "j2_spine", "j3_vs_total", "f1_rule_language", "f8_reasons", "a1_groups_and_total",
        "a5_report_preschool", "a8_district_school_age", "a11_area_tree", "i12_metric_rows", "i13_no_findings", "p3_failed_list_raw",
        "p5_total", "o1_breakdown_order", "o2_group_order", "k5_bundle_area", "k6_rule_change"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    result = compare(spark, con, SF, key, entry.queries()[key], entry.oracle_sql()[key])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).count() == 232
