import csv
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from molaris.operators import clean
from molaris.operators.areas import headline
from molaris.operators.cells import build_cells
from molaris.operators.derive import prepare
from molaris.operators.lookup import attach_area
from molaris.operators.report import report
from molaris.operators.scope import filter_area
from molaris.plans.files import ProfileError, read_profiles
from molaris.plans.profiles import PRESCHOOL, SCHOOL_AGE
from molaris.plans.rules import Band
from molaris.sources import files, sinks, snapshot


def write(path, rows, columns):
    path.write_text("\n".join([",".join(columns)] + [",".join(r.get(c, "") for c in columns) for r in rows]),
                    encoding="utf-8-sig")


@pytest.fixture
def folder(tmp_path, children):
    root = tmp_path / "in"
    root.mkdir()
    columns = list(children[0])
    write(root / "exam 0-2 +a.csv", children[:100], columns)
    write(root / "exam 3-5 .csv", children[100:], ["PID ", *[c for c in reversed(columns) if c not in ("pid", "addr")]])
    write(root / "~$exam.csv", children[:1], columns)
    return root


def test_folder_with_mixed_layouts(spark, folder, children):
    df = files.load_records(spark, str(folder))
    assert df.count() == 270
    assert {r[0] for r in df.select("_source_file").distinct().collect()} == {"exam 0-2 +a.csv", "exam 3-5 .csv"}
    assert df.where("addr IS NULL").count() == 170
    assert df.where("date_serv IS NULL").count() == len([c for c in children if c["date_serv"] == "null"])


def test_no_files_and_unknown_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_folder(spark, str(tmp_path))
    (tmp_path / "a.bin").write_text("x")
    with pytest.raises(ValueError):
        files.read_folder(spark, str(tmp_path))


def rows_of(spark, folder, **options):
    return sorted(tuple(r) for r in files.read_folder(spark, str(folder), **options).select("a", "b", "_source_file").collect())


def test_nothing_is_lost(spark, tmp_path):
    """Blank first lines, hidden names, quoted line breaks, encodings, and Parquet columns of two types."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "blank.csv").write_text("\n\na,b\n1,x\n\n2,y\n")
    (folder / "_jan.csv").write_text("b,a\nz,3\n")
    (folder / "breaks.csv").write_text('a,b\n4,"two\nlines"\n5,"with ""quotes"""\n')
    (folder / "thai.TXT").write_bytes("a,b\n6,ฟันผุ\n".encode("tis-620"))
    (folder / "utf.csv").write_text("a,b\n7,ฟันดี é\n", encoding="utf-8-sig")
    (folder / "~$utf.csv").write_text("a,b\n0,no\n")
    spark.sql("SELECT 8 AS a, 'int' AS b").coalesce(1).write.mode("append").parquet(str(tmp_path / "p1"))
    spark.sql("SELECT 'nine' AS A, 'text' AS b").coalesce(1).write.mode("append").parquet(str(tmp_path / "p2"))
    for i in (1, 2):
        next((tmp_path / f"p{i}").glob("*.parquet")).rename(folder / f"{i}.parquet")
    expected = [
        ("1", "x", "blank.csv"), ("2", "y", "blank.csv"), ("3", "z", "_jan.csv"), ("4", "two\nlines", "breaks.csv"),
        ("5", 'with "quotes"', "breaks.csv"), ("6", "ฟันผุ", "thai.TXT"), ("7", "ฟันดี é", "utf.csv"), ("8", "int", "1.parquet"),
        ("nine", "text", "2.parquet")]
    assert rows_of(spark, folder) == expected
    with pytest.raises(ValueError, match="_jan.csv"):
        files.read_folder(spark, str(folder), reader="spark")


def test_extra_values_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y,more\n")
    (tmp_path / "b.csv").write_text("a,b,c\n3,z,fine\n")
    with pytest.raises(Exception, match="more values than columns in a.csv"):
        rows_of(spark, tmp_path)
    assert [r[0] for r in rows_of(spark, tmp_path, extra_values="drop")] == ["1", "2", "3"]


def test_file_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    (tmp_path / "empty.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="empty.csv"):
        files.read_folder(spark, str(tmp_path))


def test_no_python_in_the_scan_by_spark(spark, folder):
    plan = files.load_records(spark, str(folder), reader="spark")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_date_layouts(spark):
    df = spark.createDataFrame([("15/01/2026",), ("2026-1-5",), ("2026-01-15T10:00:00Z",), (" 2026-01-16 ",), ("soon",), ("-",)], "birth string")
    layouts = ["dd/MM/yyyy", "yyyy-M-d", "yyyy-MM-dd'T'HH:mm:ssX"]
    got = [str(r[0])[:10] for r in clean.conform(df, layouts).collect()]
    assert got == ["2026-01-15", "2026-01-05", "2026-01-15", "2026-01-16", "None", "None"]
    assert [tuple(r) for r in clean.unparsed(df).collect()] == [("birth", 4)]
    assert [tuple(r) for r in clean.unparsed(df, layouts).collect()] == [("birth", 1)]


def test_snapshot_is_reused_until_files_change(spark, folder, facilities, children, tmp_path):
    root = tmp_path / "snap"
    args = (spark, str(folder), facilities, PRESCHOOL, str(root))
    df = snapshot.load_prepared(*args)
    assert df.count() == 270
    assert {r[0] for r in df.select("agegroup").distinct().collect()} == {"a0-2", "a3-5"}
    own = next((root / PRESCHOOL.id).iterdir())

    def made(kind):
        return sorted(p.name for p in own.iterdir() if p.name.startswith(kind))

    first = made("")
    snapshot.load_prepared(*args)
    assert made("") == first
    write(folder / "more 0-2.csv", children[:10], list(children[0]))
    assert snapshot.load_prepared(*args).count() == 280
    # the one before stays readable, older ones go
    assert df.count() == 270 and len(made("manifest")) == 2 and len(made("data")) == 2
    assert snapshot.load_prepared(*args, refresh=True).count() == 280
    assert len(made("manifest")) == 2 and len(made("data")) == 3
    assert snapshot.load_prepared(*args, refresh=True).count() == 280
    assert len(made("manifest")) == 2 and len(made("data")) == 2
    assert len(list((root / PRESCHOOL.id).iterdir())) == 1


def test_snapshot_follows_rules_and_facilities(spark, folder, facilities, tmp_path):
    root = str(tmp_path / "snap")

    def bands(units, profile):
        df = snapshot.load_prepared(spark, str(folder), units, profile, root)
        return {r[0] for r in df.select("band").distinct().collect()}, {r[0] for r in df.select("pvname").distinct().collect()}

    other = replace(PRESCHOOL, bands=(Band("0-5", 0, 5),))
    assert bands(facilities, PRESCHOOL) == ({"0-2", "3-5", None}, {"P1", "ไม่ระบุ"})
    assert bands(facilities, other) == ({"0-5", None}, {"P1", "ไม่ระบุ"})
    moved = facilities.withColumn("pvname", F.lit("P9"))
    assert bands(moved, other) == ({"0-5", None}, {"P9", "ไม่ระบุ"})


def test_snapshots_of_other_rule_sets_stay(spark, folder, facilities, tmp_path):
    root = tmp_path / "snap"
    longer, kept = replace(PRESCHOOL, id="p_x"), root / "p_notes"
    kept.mkdir(parents=True)
    df = snapshot.load_prepared(spark, str(folder), facilities, longer, str(root))
    for _ in range(3):
        snapshot.load_prepared(spark, str(folder), facilities, replace(PRESCHOOL, id="p"), str(root), refresh=True)
    assert df.count() == 270 and kept.exists()


def test_area_filter_skips_row_groups(spark, folder, facilities, tmp_path):
    df = snapshot.load_prepared(spark, str(folder), facilities, PRESCHOOL, str(tmp_path / "snap"))
    plan = filter_area(df, pv="P1", amp="D2")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(pvname), IsNotNull(ampname), EqualTo(pvname,P1), EqualTo(ampname,D2)]" in plan


def test_bundle_and_csv(spark, records, tmp_path):
    cells = build_cells(prepare(records, SCHOOL_AGE), SCHOOL_AGE)
    parts = sinks.write_bundle(cells, SCHOOL_AGE, str(tmp_path / "b"), "2026-02-01", fmt="csv")
    assert parts == ["header", "findings", "districts", *[f"table_{n}" for n in range(1, 7)], "notes"]
    assert sinks.read_part(spark, str(tmp_path / "b"), "table_2", "csv").count() == 8
    head = sinks.read_part(spark, str(tmp_path / "b"), "header", "csv")
    assert head.count() == 12
    shown = {r["รายการ"]: r["ค่า"] for r in head.collect()}
    notes = sinks.read_part(spark, str(tmp_path / "b"), "notes", "csv").where("table_no = '2'").orderBy("ord").collect()
    assert [r["note"] for r in notes] == ["ตารางที่ 2 " + SCHOOL_AGE.table("2").title, *SCHOOL_AGE.table("2").conditions]
    assert shown["เด็กในเขตรับผิดชอบ (คน)"] == str(headline(cells, SCHOOL_AGE).first()["target"])


def test_bundle_of_a_district_and_a_unit(spark, records, facilities, tmp_path):
    cells = build_cells(prepare(attach_area(records, facilities), PRESCHOOL), PRESCHOOL)

    def bundle(name, **area):
        parts = sinks.write_bundle(cells, PRESCHOOL, str(tmp_path / name), "2026-02-01", **area)
        head = {r["รายการ"]: r["ค่า"] for r in sinks.read_part(spark, str(tmp_path / name), "header").collect()}
        return parts, head["เด็กในเขตรับผิดชอบ (คน)"], head["ขอบเขต"]

    parts, target, area = bundle("district", pv="P1", amp="D1")
    assert "units" in parts and "districts" not in parts and (target, area) == ("90", "P1 › D1")
    assert sinks.read_part(spark, str(tmp_path / "district"), "units").count() == 1
    parts, target, area = bundle("unit", pv="P1", amp="D1", hos="11111")
    assert "units" not in parts and "districts" not in parts and target == "90"


def test_failed_bundle_leaves_the_one_before(spark, records, tmp_path, monkeypatch):
    cells = build_cells(prepare(records, PRESCHOOL), PRESCHOOL)
    path = str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        sinks.read_part(spark, path, "header")
    sinks.write_bundle(cells, PRESCHOOL, path, "2026-02-01")
    before = {p: sinks.read_part(spark, path, p).collect() for p in ("header", "table_2", "notes")}

    def fails(*args):
        raise RuntimeError("lost")

    other = cells.where("pvname = 'P1'")
    with monkeypatch.context() as m:
        m.setattr(sinks, "notes_table", fails)
        with pytest.raises(RuntimeError):
            sinks.write_bundle(other, PRESCHOOL, path, "2026-02-01")
    with monkeypatch.context() as m:
        m.setattr(sinks, "PARTS", "nowhere")  # all parts are there, their list is not
        sinks.write_bundle(other, PRESCHOOL, path, "2026-02-01")
    assert {p: sinks.read_part(spark, path, p).collect() for p in before} == before
    old = sinks.read_part(spark, path, "header")
    sinks.write_bundle(other, PRESCHOOL, path, "2026-03-01")
    assert sinks.read_part(spark, path, "header").collect() != before["header"] == old.collect()
    assert len(sinks.bundles(spark, path)) == 2


RULES = """
{"id": "mini", "age_range": [3, 5], "quality_filter": "providertype in ['02', '06'] and dteeth >= 1",
 "bands": [{"label": "3-5", "min": 3, "max": 5}], "quality_extra": {"3-5": "dteeth + dextract == 20"},
 "quality_checks": [{"name": "teeth", "expr": "dteeth >= 1", "bands": ["3-5"]}],
 "filename_columns": [{"column": "agegroup", "rules": [{"contains": "3-5", "value": "a3-5"}]}],
 "overview": {"dmft": "dcaries", "dmft_label": "caries"},
 "tables": [{"no": 1, "title": "q", "kind": "quality", "rows": "bands", "conditions": ["note"]},
            {"no": 2, "title": "c", "kind": "count_pct", "rows": "bands", "denominator": "sex != '1'",
             "metrics": [{"name": "m", "expr": "dcaries + dfilling == 0"}]}]}
"""


def test_rule_sets_from_files(spark, tmp_path):
    (tmp_path / "mini.json").write_text(RULES)
    (tmp_path / "draft.json").write_text('{"label": "no id"}')
    (tmp_path / "notes.txt").write_text("no rule set")
    found = read_profiles(spark, str(tmp_path))
    assert list(found) == ["mini"]
    p = found["mini"]
    assert p.quality_filter == "(coalesce(`providertype` IN ('02', '06'), false) AND (`dteeth` >= 1))"
    assert p.table("2").denominator == "(NOT (`sex` <=> '1'))" and p.bands == (Band("3-5", 3, 5),)
    assert p.overview.dmft_label == "caries" and p.quality_checks[0].bands == ("3-5",)
    (tmp_path / "bad.json").write_text(RULES.replace("dteeth >= 1", "dteeth >>= 1"))
    with pytest.raises(ProfileError, match="bad.json"):
        read_profiles(spark, str(tmp_path))


def test_rule_sets_compiled_by_the_records(spark, records, tmp_path):
    (tmp_path / "mini.json").write_text(RULES)
    df = prepare(records, PRESCHOOL)
    assert read_profiles(spark, str(tmp_path), df)["mini"].quality_filter == read_profiles(spark, str(tmp_path))["mini"].quality_filter
    (tmp_path / "mini.json").write_text(RULES.replace("dcaries + dfilling == 0", "dcaries + d_filling == 0"))
    with pytest.raises(ProfileError, match="no column d_filling"):
        read_profiles(spark, str(tmp_path), df)


def test_rule_set_file_gives_the_report_of_its_rules(spark, records, tmp_path):
    (tmp_path / "mini.json").write_text(RULES)
    p = read_profiles(spark, str(tmp_path))["mini"]
    df = prepare(records, p)
    base = report(df, p).where("is_total AND table_no = '2'").first()
    scope = df.where("examined AND age BETWEEN 3 AND 5 AND NOT (sex <=> '1')")
    assert base["base"] == scope.count() and base["n"] == scope.where("dcaries + dfilling = 0").count()


def test_dictionary(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('NAME,CAPTION,DESCRIPTION\n PID ,c,"1=a, 2=b"\n', encoding="utf-8-sig")
    assert [tuple(r) for r in files.read_dictionary(spark, str(path)).collect()] == [("pid", "c", "1=a, 2=b")]


ODD = ["", " ", "-", " - ", "<NA>", " <NA> ", "N/A", " N/A", "NULL", "null ", "NAN", "nan", "　x ", "x\x85", "\x1cx", "\x00x", " #N/A", "ฟัน ",
       " 7 ", " 7", "\x017", "1_000", "１", "5d", "0x1p3", "1e400", "-1e-400", ".", "1.", "+.5e-3", "-.5E+3", "inf", "-Infinity", "iNf",
       "1e5.", "1e", "--1", "1,000", "00012", "-0", "0.1", "4.9e-324", "9007199254740993", "1e23", "20010203", "2001-02-30", " 2001-02-03 04:05 "]


def test_values_cleaned_where_they_are_read(spark, tmp_path):
    """Text files are cleaned by their reader as ``conform`` cleans them, also beside typed Parquet columns of the same names."""
    folder = tmp_path / "in"
    folder.mkdir()
    columns = ["pteeth", " Birth", "hoscode", "_kept", "sex", "real", "flag"]
    with open(folder / "a.csv", "w", newline="", encoding="utf-8") as file:
        csv.writer(file, quoting=csv.QUOTE_ALL).writerows([columns, *([v] * len(columns) for v in ODD)])
    (folder / "b.csv").write_text("hoscode,pextract\n 1 ,5d\n-,2\nshort\n")
    spark.sql("SELECT CAST(0.1 AS FLOAT) AS pteeth, TIMESTAMP '2001-02-03 04:05:06' AS birth, ' 00 ' AS hoscode, 1 AS sex, "
              "CAST('NaN' AS DOUBLE) AS pcaries, true AS flag, 2.5D AS own").coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(folder / "c.parquet")
    found, want = files.load_records(spark, str(folder)), clean.conform(files.read_folder(spark, str(folder)))
    assert found.dtypes == want.dtypes
    rows = sorted(map(str, found.collect()))
    assert len(rows) == len(ODD) + 4 and rows == sorted(map(str, want.collect()))
    # no look at both ends of every text any more
    text = files.load_records(spark, str(folder), "*.csv")._jdf.queryExecution().optimizedPlan().toString()
    assert "trim" not in text and "trim" in want._jdf.queryExecution().optimizedPlan().toString()
