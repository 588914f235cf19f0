import pytest
from pyspark.sql import functions as F

from molaris.operators import areas, lookup, people, scope
from molaris.operators.cells import LEVELS, build_cells, report_rows
from molaris.operators.derive import prepare
from molaris.operators.findings import findings, findings_table
from molaris.operators.lookup import attach_area, conform_facilities, first_per_key, hot_keys, left_lookup
from molaris.operators.report import long_report, report, wide_table
from molaris.plans import labels as L
from molaris.plans.profiles import PRESCHOOL, PROFILES, SCHOOL_AGE
from molaris.plans.rules import COUNT_PCT, Band, Metric, Overview, Profile, Table

BOTH = pytest.mark.parametrize("profile", PROFILES.values(), ids=list(PROFILES))


@pytest.fixture(scope="module", params=list(PROFILES))
def made(request, records, facilities):
    profile = PROFILES[request.param]
    df = prepare(attach_area(records, facilities), profile).cache()
    return profile, df, build_cells(df, profile).cache()


def test_counts_reconcile_with_lists_and_breakdowns(made):
    profile, df, cells = made
    head = areas.headline(cells, profile).first()
    assert head["target"] == 270 == head["examined"] + head["pending"] + head["out_of_range"]
    pending = people.pending_list(df, "2026-02-01").count()
    failed = people.failed_list(df, profile, "2026-02-01")
    assert pending == head["pending"]
    assert failed.count() == head["examined"] - head["qualified"]
    assert failed.where(F.col("สาเหตุที่ไม่ผ่านเกณฑ์").isNull()).count() == 0
    for by in ("district", "unit"):
        rows = areas.breakdown(cells, profile, by).collect()
        assert sum(r["pending"] for r in rows) == pending
        assert sum(r["failed"] for r in rows) == failed.count()
    district = areas.breakdown(cells, profile, "district").collect()
    assert [r["name"] for r in district] == ["D1", "D2", "ไม่ระบุ"]


def test_lookup_after_sums_gives_the_same_report(made, records, facilities):
    profile, df, cells = made
    late = build_cells(prepare(records, profile), profile, facilities)
    a = long_report(report_rows(cells, profile, LEVELS), profile)
    b = long_report(report_rows(late, profile, LEVELS), profile)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_report_shape_and_findings(made):
    profile, df, cells = made
    rows = report_rows(cells, profile)
    long = long_report(rows, profile)
    groups = {"age": profile.age_max - profile.age_min + 1, "band": len(profile.bands)}
    for table in profile.tables:
        shown = wide_table(rows, profile, table.no).collect()
        assert len(shown) == groups[table.row_kind] + 1
        assert shown[-1][0] == "รวม"
    found = findings(long, profile)
    assert {r["table_no"] for r in found.collect()} == {t.no for t in profile.tables}
    assert findings_table(found, profile).count() == found.count()


@BOTH
def test_no_records_still_gives_every_row(spark, records, profile):
    empty = prepare(records.where("false"), profile)
    cells = build_cells(empty, profile)
    total = long_report(report_rows(cells, profile), profile).where("is_total").collect()
    assert total and all(r["base"] == 0 and r["value"] is None for r in total)
    assert areas.headline(cells, profile).first()["qualified_pct"] == 0


def test_row_in_no_band_is_neither_qualified_nor_failed(spark):
    p = Profile("p", "p", 0, 9, "true", (Table("1", "t", COUNT_PCT, metrics=(Metric("m", None),)),),
                bands=(Band("low", 0, 2),), quality_extra=(("low", "x > 0"),), overview=Overview("false", "0"))
    df = spark.sql("SELECT true AS examined, 5 AS age, CAST(NULL AS STRING) AS band, 0 AS x")
    assert scope.failed(df, p).count() == 0
    assert report(df, p).where("is_total").first()["base"] == 0


def test_unknown_kind_is_an_error():
    with pytest.raises(ValueError):
        Table("1", "t", "histogram")


def test_missing_inputs_degrade(spark):
    row = prepare(spark.sql("SELECT 'a' AS pid"), PRESCHOOL).first()
    assert row["age"] is None and row["examined"] is False and row["gum_status"] is None and row["band"] is None


def test_index_sum_keeps_null_only_when_all_are_null(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS pcaries, 0D AS pfilling, 0D AS pextract UNION ALL SELECT NULL, NULL, NULL")
    assert sorted(r["dmft_p"] is None for r in prepare(df).collect()) == [False, True]


def test_lookup_null_keys_hot_keys_and_salting(spark, facilities):
    records = spark.range(0, 300, 1, 6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN ' 11111 ' WHEN id % 3 = 1 THEN NULL ELSE '99999' END AS hoscode",
        "CAST(NULL AS STRING) AS hosname", "id")
    plain = attach_area(records, facilities, broadcast=True)
    salted = attach_area(records, facilities, broadcast=False)
    assert plain.count() == 300 and plain.exceptAll(salted).count() == 0
    assert plain.where("hosname = 'A' AND ampname = 'D1'").count() == 100
    assert plain.where("ampname = 'ไม่ระบุ'").count() == 200


def test_dimension_is_broadcast_as_memory_allows(spark, monkeypatch):
    """More rows than the fixed bound: no shuffle of the records while the table takes a small share of the heap."""
    def plan():
        dim = spark.range(260_000).selectExpr("CAST(id AS STRING) AS k", "id AS n")
        facts = spark.range(10).selectExpr("CAST(id AS STRING) AS k")
        return left_lookup(facts, dim, "k")._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan() and "SortMergeJoin" not in plan()
    monkeypatch.setattr(lookup, "smallest_heap", lambda spark: 100 << 20)
    assert "SortMergeJoin" in plan()


def test_first_facility_wins_after_trimming(spark):
    raw = spark.createDataFrame([("1 ", "second", "02-D", 2), ("1", "first", "01-C", 1), (None, "x", "y", 0)],
                                "HOSCODE string, hosname string, ampname string, o int")
    rows = conform_facilities(raw, F.col("o")).collect()
    assert [tuple(r) for r in rows] == [("1", "first", "C")]
    assert first_per_key(raw, "hosname", F.col("o")).count() == 3


def test_lists_are_sorted_with_nulls_last(made):
    profile, df, _ = made
    rows = people.failed_list(df, profile, "2026-02-01").collect()
    keys = [(r["รหัสหน่วยบริการ"], r["อายุขณะตรวจ (ปี)"]) for r in rows]
    assert keys == sorted(keys)
    raw = people.failed_list(df, profile, "2026-02-01", raw=True).columns
    assert "pid_raw" in raw and len({c.lower() for c in raw}) == len(raw)
    groups = people.column_groups(df.columns, L.FAILED_COLUMNS, True)
    assert "PID" in groups["main"] and "pid_raw" in groups["raw"] and "dmft_p" in groups["computed"]


def test_page_knows_the_size_of_the_list(made):
    profile, df, _ = made
    listed = people.failed_list(df, profile, "2026-02-01")
    page = people.first_page(listed, 3)
    assert page.rows.count() == 3 and tuple(page.counts.first()) == (3, listed.count())


def test_pages_one_after_the_other_are_the_list(made):
    profile, df, _ = made
    twice = df.union(df.where("hoscode = '11111'")).union(df.where("pid = 'P7'"))
    for listed, page in ((people.failed_list(twice, profile, "2026-02-01"), lambda n, a: people.failed_page(twice, profile, "2026-02-01", n, a)),
                         (people.pending_list(twice, "2026-02-01"), lambda n, a: people.pending_page(twice, "2026-02-01", n, a))):
        rows, after, total = [], None, listed.count()
        while True:
            found = page(37, after)
            rows += found.rows
            after = found.after
            assert found.total == total and found.shown == len(found.rows) <= 37
            if after is None:
                break
        assert sorted(map(str, rows)) == sorted(map(str, listed.collect())) and len(rows) == total > 37
        keys = [r["รหัสหน่วยบริการ"] for r in rows]
        assert keys == sorted(keys)
    empty = people.pending_page(df, "2026-02-01", pv="nowhere")
    assert (empty.rows, empty.shown, empty.total, empty.after) == ([], 0, 0, None)


def test_a_page_is_one_scan(spark, made):
    profile, df, _ = made
    df.count()
    spark.sparkContext.setJobGroup(f"page {profile.id}", "page")
    people.pending_page(df, "2026-02-01", 5)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"page {profile.id}")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("share", [0.0, 0.34, 0.9])
def test_hot_key_is_dealt_over_tasks(spark, share):
    """One code in most rows, and rows without one; the largest task stays near the median, without help at run time."""
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(kept, ("false", "-1", "32")):
            spark.conf.set(k, v)
        facts = spark.range(0, 200_000, 1, 8).selectExpr(
            f"CASE WHEN id % 100 < {int(share * 100)} THEN 'hot' WHEN id % 100 >= 95 THEN NULL ELSE CAST(id % 20000 AS STRING) END AS k",
            "id AS v", "1 AS _salt0")
        dim = spark.range(0, 20_000).selectExpr("CAST(id AS STRING) AS k", "id AS n").unionByName(spark.sql("SELECT 'hot' AS k, -1L AS n"))
        salts = hot_keys(facts, "k", 32)
        assert set(salts) == ({"hot"} if share else set())
        joined = left_lookup(facts, dim, "k", broadcast=False)
        assert joined.columns == ["k", "v", "_salt0", "n"] and "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        wrong = joined.where("NOT (n <=> CASE WHEN k = 'hot' THEN -1 ELSE CAST(k AS BIGINT) END)")
        assert joined.count() == joined.select("v").distinct().count() == 200_000 and wrong.isEmpty()
        tasks = sorted(r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert len(tasks) == 32 and tasks[-1] <= 3 * tasks[16], tasks
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_area_tree_has_every_level(made):
    _, df, _ = made
    rows = [tuple(r) for r in areas.area_tree(df).collect()]
    assert rows[0] == ("province", "P1", None, None, None)
    assert ("facility", "P1", "D1", "11111", "clinic") in rows
    assert ("facility", "ไม่ระบุ", "ไม่ระบุ", "33333", "clinic") in rows
