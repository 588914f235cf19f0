"""One query per operator; each reads the given tables whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import views as V
from molaris.functions import sql
from molaris.functions.numeric import percent, scaled_percent, with_rounded
from molaris.functions.rule_language import kinds_of, to_sql
from molaris.functions.rules import amount, met
from molaris.functions.text import blank_to_null, drop_number_prefix, strip
from molaris.operators import areas, clean, export, findings as fnd, people, scope
from molaris.operators.cells import LEVELS, Measures, build_cells, report_rows
from molaris.operators.lookup import first_per_key
from molaris.operators.report import long_report, report, wide_table
from molaris.plans.profiles import PRESCHOOL, SCHOOL_AGE
from molaris.plans.rules import COUNT_PCT, MEAN, Band, Metric, NameColumn, NameRule, Overview, Profile, Table
from molaris.sources import files, sinks, snapshot
from molaris.sources.storage import drop_folder, new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def counted(df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def register(name: str, f: Query) -> None:
    QUERIES[name] = f


# Sources -----------------------------------------------------------------------------------

_WRITTEN: dict[tuple[str, str], str] = {}


def written_folder(spark: SparkSession, sf_dir: str) -> str:
    """The dirty records as a folder of files in three layouts, written once per application."""
    done = (spark.sparkContext.applicationId, sf_dir)
    if done in _WRITTEN:
        return _WRITTEN[done]
    folder = new_folder(spark, "records")
    raw = V.text_records(spark, sf_dir)
    pid = F.trim(F.translate("pid", " ", "")).cast("bigint")

    def save(part: DataFrame, fmt: str) -> None:
        part.write.mode("append").format(fmt).option("header", True).option("escape", '"').save(folder)

    # every seventh person's address goes over two lines
    text = raw.withColumn("addr", F.when(pid % 7 == 0, F.translate("addr", "/", "\n")).otherwise(F.col("addr")))
    save(text.where((pid % 3 == 0) & (pid % 50 != 0)), "csv")
    save(text.where(pid % 3 == 1).select(*[F.col(f"`{c}`") for c in reversed(raw.columns) if c != "gum"]), "csv")
    # one column with two types
    save(raw.where((pid % 3 == 2) & (pid % 2 == 0)).withColumn("extra", F.lit("x")), "parquet")
    save(raw.where((pid % 3 == 2) & (pid % 2 == 1)).withColumn("extra", F.lit(1)), "parquet")
    named_file(text.where((pid % 3 == 0) & (pid % 100 == 0)), folder, "blank first line.csv", ["", ""])
    named_file(text.where((pid % 3 == 0) & (pid % 100 == 50)), folder, "_hidden.csv", [])
    _WRITTEN[done] = folder
    return folder


def named_file(df: DataFrame, folder: str, name: str, before: list[str]) -> None:
    """Write a small table as one CSV file of this name, some lines in front of the header."""
    spark = df.sparkSession
    header = ",".join(f'"{c}"' for c in df.columns)
    head = spark.createDataFrame([(i, line) for i, line in enumerate([*before, header])], "ord int, value string")
    rows = df.select(F.lit(len(before) + 1).alias("ord"), F.to_csv(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"quoteAll": "true", "escape": '"'}).alias("value"))
    path = new_folder(spark, "one")
    head.unionByName(rows).repartition(1).sortWithinPartitions("ord").select("value").write.text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    part, system = hadoop(f"{path}/part-*"), hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.rename(system.globStatus(part)[0].getPath(), hadoop(f"{folder}/{name}"))


def load(spark, folder):
    return files.load_records(spark, folder)


@query
def s1_folder_scan(spark, sf):
    df = load(spark, written_folder(spark, sf))
    return df.groupBy("extra").agg(
        F.expr(r"count_if(contains(addr, '\n'))").alias("broken"), F.count_distinct("addr").alias("addresses"),
        F.count(F.lit(1)).alias("n"), F.count("hoscode").alias("hoscodes"), F.count("gum").alias("gums"),
        F.count("birth").alias("births"), F.count("date_serv").alias("served"),
        F.sum("pteeth").alias("pteeth"), F.count_distinct("cid").alias("persons"))


@query
def s1_ranges(spark, sf):
    """The text files by ranges of 64 KB, many to a file, with quoted line breaks across their borders."""
    listed = files.list_files(spark, written_folder(spark, sf)).where(files.IS_TEXT)
    df = clean.conform(files.read_ranges(listed, files.kinds_of(listed)[0], split=64 << 10))
    return df.groupBy(F.col("gum").isNull().alias("no_gum")).agg(
        F.expr(r"count_if(contains(addr, '\n'))").alias("broken"), F.count_distinct("addr").alias("addresses"),
        F.count(F.lit(1)).alias("n"), F.count("hoscode").alias("hoscodes"), F.count("birth").alias("births"),
        F.sum("pteeth").alias("pteeth"), F.count_distinct("cid").alias("persons"))


@query
def s2_source_file(spark, sf):
    df = load(spark, written_folder(spark, sf))
    kind = F.regexp_extract("_source_file", r"\.([a-z]+)$", 1)
    return counted(df.select(kind.alias("kind"), F.col("_source_file").startswith("part-").alias("plain")),
                   "kind", "plain")


@query
def s3_facilities(spark, sf):
    path = new_folder(spark, "facilities")
    raw = V.raw_facilities(spark, sf).orderBy("HOSCODE ")
    raw.drop("_copy").write.option("header", True).csv(path)
    return files.read_facilities(spark, path)


@query
def s3_facilities_thai(spark, sf):
    path = new_folder(spark, "facilities")
    thai, plain = "โรงพยาบาลฯ๑", "".join(chr(ord(c) - 0x0E00 + 0xA0) for c in "โรงพยาบาลฯ๑")
    raw = V.raw_facilities(spark, sf).withColumn("hosname", F.concat(F.lit(thai + " "), "hosname"))
    shown = raw.orderBy("HOSCODE ").withColumn("hosname", F.translate("hosname", thai, plain))
    shown.drop("_copy").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_facilities(spark, path).select("hoscode", "hosname", "ampname")


@query
def s4_dictionary(spark, sf):
    path = new_folder(spark, "dictionary")
    V.table(spark, sf, "part").select(
        F.format_string(" Field_%d ", "p_partkey").alias("NAME"), F.col("p_name").alias("CAPTION"),
        F.format_string('%s, "%s"', "p_brand", "p_type").alias("DESCRIPTION"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return files.read_dictionary(spark, path)


@query
def u1_append_by_name(spark, sf):
    a = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    b = V.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("m"), F.col("c_custkey").alias("id"))
    return counted(files.append_by_name(a, b), "s", "m")


# Cleaning ----------------------------------------------------------------------------------

@query
def n1_headers(spark, sf):
    df = clean.tidy_headers(V.text_records(spark, sf))
    return df.groupBy("hoscode").agg(F.count("pteeth").alias("n"))


@query
def n2_null_tokens(spark, sf):
    df = V.text_records(spark, sf)
    return counted(df.selectExpr(f"{blank_to_null('` PTEETH`')} AS value"), "value")


@query
def n3_numeric(spark, sf):
    df = clean.conform(V.text_records(spark, sf))
    return counted(df, "pteeth", "need_pextract")


@query
def n4_dates(spark, sf):
    df = clean.conform(V.text_records(spark, sf))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return counted(df.select(F.date_format("date_serv", fmt).alias("date_serv"),
                             F.date_format(F.date_trunc("month", "birth"), fmt).alias("birth_month")),
                   "date_serv", "birth_month")


@query
def n4_birth_days(spark, sf):
    df = clean.conform(V.text_records(spark, sf))
    return counted(df.select(F.date_format("birth", "yyyy-MM-dd").alias("birth")), "birth")


@query
def n4_layouts(spark, sf):
    df = clean.conform(V.text_records(spark, sf), ["yyyy/MM/dd", "dd/MM/yyyy"])
    return counted(df.select(F.date_format("date_serv", "yyyy-MM-dd").alias("date_serv")), "date_serv")


@query
def n4_unparsed(spark, sf):
    return clean.unparsed(V.text_records(spark, sf))


@query
def n5_codes(spark, sf):
    return counted(clean.conform(V.text_records(spark, sf)), "hoscode", "providertype", "sex")


def _named(spark, sf):
    pid = F.col("pid").cast("bigint")
    source = F.when(pid % 4 == 0, "Exam 0-2 YEARS.csv").when(pid % 4 == 1, "exam 3-5.csv").when(
        pid % 4 == 2, "3-5 and 0-2.csv").otherwise("other.csv")
    return V.records(spark, sf).withColumn("_source_file", source)


@query
def n6_filename_rules(spark, sf):
    rules = (NameRule("0-2 years", "young"), NameRule("3-5", "older"), NameRule("", "never"))
    df = clean.add_name_columns(_named(spark, sf), [
        NameColumn("agegroup", PRESCHOOL.filename_columns[0].rules),
        NameColumn("rated", rules, default="unrated"),
        NameColumn("sex", rules),
        NameColumn("denttype", rules, overwrite=True),
    ])
    return counted(df, "_source_file", "agegroup", "rated", "sex", "denttype")


@query
def n7_prefix_strip(spark, sf):
    df = V.raw_facilities(spark, sf)
    return counted(df.selectExpr(f"{drop_number_prefix('AMPNAME')} AS amp",
                                 f"{drop_number_prefix('pvname')} AS pv"), "amp", "pv")


@query
def n8_first_per_key(spark, sf):
    df = V.records(spark, sf).select("hoscode", "cid", "birth", "gum")
    first = first_per_key(df, "hoscode", F.struct("birth", "cid"))
    return first.select("hoscode", "cid", F.date_format("birth", "yyyy-MM-dd").alias("birth"), "gum")


# Joins -------------------------------------------------------------------------------------

def _lookup(broadcast):
    return lambda spark, sf: counted(V.attached(spark, sf, broadcast), "hoscode", "hosname", "hosname_ref",
                                     "hostype", "ampcode", "ampname", "pvname", "tumbonname")


register("j1_facility_lookup", _lookup(None))
register("j1_facility_lookup_salted", _lookup(False))


def cells_of(spark, sf, profile):
    """Cells with the facility looked up after the sums."""
    return build_cells(V.unattached(spark, sf, profile), profile, V.facilities(spark, sf))


def long_of(spark, sf, profile, levels=("all",)):
    return long_report(report_rows(cells_of(spark, sf, profile), profile, levels), profile)


def school_long(spark, sf, levels=("all",)):
    return long_of(spark, sf, SCHOOL_AGE, levels)


def preschool_long(spark, sf, levels=("all",)):
    return long_of(spark, sf, PRESCHOOL, levels)


# No record is as old as the oldest ages, and few are of this quality: groups without records.
SPARSE = Profile(
    id="sparse", label="sparse", age_min=0, age_max=14, quality_filter="pteeth > 26 AND dteeth > 18",
    tables=(Table("1", "any", COUNT_PCT, metrics=(Metric("caries", "pcaries > 0"),)),),
)


@query
def j2_spine(spark, sf):
    long = report(V.prepared(spark, sf, SPARSE), SPARSE, ["all", "facility_code"])
    return long.select("level", "hoscode", "row_label", "base", "n", "value")


@query
def j3_vs_total(spark, sf):
    long = school_long(spark, sf, ["all", "district"])
    return fnd.compare_to_total(long).where(~F.col("is_total")).select(
        "level", "pvname", "ampname", "table_no", "row_label", "metric", "value", "total_value", "gap")


# Derived columns ---------------------------------------------------------------------------

def derived(*columns):
    def run(spark, sf):
        from molaris.operators.derive import prepare
        return counted(prepare(V.records(spark, sf), PRESCHOOL), *columns)
    return run


register("d1_age_years", derived("age"))
register("d2_age_months", derived("age_month"))
register("d3_examined", derived("examined"))
register("d5_gum_status", derived("gum", "gum_status"))
register("d6_gum_sextants", derived("gum", "gum_sx_0", "gum_sx_1", "gum_sx_2", "gum_sx_3", "gum_sx_9"))
register("d7_gum_label", derived("gum_status", "gum_label"))
register("d8_indices", derived("dmft_p", "dmft_d"))
register("d9_band", derived("age", "band"))


@query
def d4_gum_normal(spark, sf):
    from molaris.functions.gum import normal_gum
    df = clean.tidy_headers(V.text_records(spark, sf))
    trimmed = df.selectExpr(f"{strip('gum')} AS gum")
    return counted(trimmed.selectExpr(f"coalesce({normal_gum('gum')}, '') AS gum"), "gum")


def person(*columns):
    return lambda spark, sf: counted(people.person_fields(V.records(spark, sf), V.AS_OF), *columns)


register("d10_age_today", person("age_today"))
register("d11_sex_label", person("sex", "sex_label"))
register("d12_provider_label", person("providertype", "provider_label"))


@query
def d13_date_text(spark, sf):
    df = people.person_fields(V.records(spark, sf), V.AS_OF)
    stamp = F.date_format("d_update", "yyyy-MM-dd HH:mm:ss").alias("d_update")
    return counted(df.select("date_str", F.substring("birth_str", 1, 7).alias("birth_month"),
                             F.substring(stamp, 1, 13).alias("hour")), "date_str", "birth_month", "hour")


@query
def d13_birth_text(spark, sf):
    return counted(people.person_fields(V.records(spark, sf), V.AS_OF).select("birth_str"), "birth_str")


@query
def d14_percent(spark, sf):
    ratios = V.table(spark, sf, "lineitem").selectExpr(
        "l_partkey % 1000 AS n", "l_orderkey % 1000 AS d", "l_extendedprice / (l_quantity * 8) AS p")
    shown = with_rounded(ratios.selectExpr("*", f"{percent('n', 'd')} AS x"), {
        "pct": ("x", 2), "price": ("p", 2), "minus": ("-p", 1), "eighths": ("n / 8D", 0)})
    return shown.selectExpr("*", f"{scaled_percent('x')} AS pct_scaled").groupBy(
        "n", "d", "pct", "pct_scaled", "price", "minus", "eighths").agg(F.expr("count(1) AS rows"))


# Filters -----------------------------------------------------------------------------------

RULES = {
    "no_rule": None, "never": False, "null_sum": "pcaries + pfilling + pextract = 0",
    "null_order": "need_pfilling >= 1 AND NOT (need_pfilling > 1)", "is_known": "sex IN ('1', '2')",
    "text_equal": "gum <=> '000000'", "text_not_equal": "NOT (gum <=> '000000')",
    "not_member": "NOT coalesce(providertype IN ('02', '06'), false)", "number_as_flag": "pcaries",
    "either": "need_pfilling > 0 OR need_dfilling > 0",
}


@query
def f1_rules(spark, sf):
    df = V.records(spark, sf)
    return df.agg(*[F.expr(f"count_if({met(rule)}) AS {name}") for name, rule in RULES.items()],
                  F.expr(f"sum({amount('pcaries + dcaries')}) AS value"),
                  F.expr(f"sum({amount('sex')}) AS text_value"))


# The same rules as in a rule-set file.
WRITTEN_RULES = {
    "never": False, "null_sum": "pcaries + pfilling + pextract == 0",
    "null_order": "need_pfilling >= 1 and not (need_pfilling > 1)", "chain": "1 <= need_pfilling < 2",
    "is_known": "sex in ['1', '2']", "not_known": "sex not in ['1', '2']", "text_equal": "gum == '000000'",
    "text_not_equal": "gum != '000000'", "not_member": "not (providertype in ['02','06'])",
    "either": "need_pfilling > 0 or need_dfilling > 0", "signs": "(need_pfilling > 0) | (need_dfilling > 0) & ~(sex == '1')",
    "number_unequal": "pcaries != 0", "in_numbers": "pteeth in [1, 2, 3]", "minus": "need_dextract == -1",
    "half": "pteeth / 2 > 7.5",
}


@query
def f1_rule_language(spark, sf):
    df = V.records(spark, sf)
    return df.agg(*[F.expr(f"count_if({met(to_sql(rule))}) AS {name}") for name, rule in WRITTEN_RULES.items()])


# Rules whose meaning hangs on the types of their columns.
TYPED_RULES = {
    "texts_differ": "providertype != sex", "texts_equal": "providertype == sex", "not_texts_equal": "not (gum == hoscode)",
    "text_is_number": "sex == 1", "text_is_no_number": "sex != 1", "number_is_text": "pteeth == '3'", "number_is_no_text": "pteeth != '3'",
    "added_texts": "sex + providertype == '202'", "added_texts_differ": "sex + providertype != '202'", "mixed_list": "sex in [1, '2']",
    "outside_mixed_list": "sex not in [1, '2']", "no_member": "pteeth in ['3']", "text_order": "providertype > '01'",
    "numbers_differ": "pteeth != dteeth", "times": "date_serv >= birth",
}


@query
def f1_typed_rules(spark, sf):
    df = V.records(spark, sf)
    kinds = kinds_of(df.dtypes)
    return df.agg(*[F.expr(f"count_if({met(to_sql(rule, kinds))}) AS {name}") for name, rule in TYPED_RULES.items()])


@query
def f2_scope(spark, sf):
    return counted(scope.scope(V.prepared(spark, sf, SCHOOL_AGE), SCHOOL_AGE), "age", "examined")


@query
def f3_area(spark, sf):
    df = V.prepared(spark, sf, PRESCHOOL)
    return counted(scope.filter_area(df, pv="ASIA", amp="District 2"), "pvname", "ampname", "hoscode")


@query
def f4_quality(spark, sf):
    df = scope.scope(V.prepared(spark, sf, PRESCHOOL), PRESCHOOL)
    return counted(df.selectExpr("band", f"{scope.qualified(PRESCHOOL)} AS q"), "band", "q")


DENOMINATORS = Profile(
    id="denominators", label="denominators", age_min=0, age_max=12, quality_filter="pteeth > 5",
    tables=tuple(
        Table(no, no, COUNT_PCT, rows="none", denominator=rule, metrics=(Metric("caries", "pcaries > 0"),))
        for no, rule in [("1", "qualified"), ("2", "examined"), ("3", "all"), ("4", "sex <=> '1'")]
    ) + (Table("5", "5", MEAN, rows="none", denominator="pteeth > 1000", metrics=(Metric("m", "pteeth"),)),),
)


@query
def f5_denominators(spark, sf):
    long = report(V.prepared(spark, sf, DENOMINATORS), DENOMINATORS)
    return long.select("table_no", "row_label", "base", "n", "total", "value")


@query
def f6_pending(spark, sf):
    return counted(scope.pending(V.prepared(spark, sf, PRESCHOOL)), "pvname", "ampname")


@query
def f7_failed(spark, sf):
    return counted(scope.failed(V.prepared(spark, sf, PRESCHOOL), PRESCHOOL), "ampname", "age")


@query
def f8_reasons(spark, sf):
    df = scope.failed(V.prepared(spark, sf, PRESCHOOL), PRESCHOOL)
    return counted(df.selectExpr("band", f"{scope.fail_reason(PRESCHOOL)} AS reason"), "band", "reason")


# Aggregations ------------------------------------------------------------------------------

def rows_of(spark, sf, profile, levels=("all",)):
    return report_rows(cells_of(spark, sf, profile), profile, levels)


def wide(profile, no):
    return lambda spark, sf: wide_table(rows_of(spark, sf, profile), profile, no)


register("a2_quality_age", wide(SCHOOL_AGE, "1"))
register("a2_quality_bands", wide(PRESCHOOL, "1"))
register("a3_count_pct_caries_age", wide(SCHOOL_AGE, "2"))
register("a3_count_pct_gum_age", wide(SCHOOL_AGE, "4"))
register("a3_count_pct_needs_age", wide(SCHOOL_AGE, "6"))
register("a3_count_pct_caries_bands", wide(PRESCHOOL, "2"))
register("a3_count_pct_needs_bands", wide(PRESCHOOL, "7"))
register("a4_mean_teeth_age", wide(SCHOOL_AGE, "3"))
register("a4_mean_sextants_age", wide(SCHOOL_AGE, "5"))
register("a4_mean_teeth_bands", wide(PRESCHOOL, "3"))

SHOWN = ["table_no", "row_label", "metric", "base", "n", "total", "value"]

# Both row kinds and the total alone in one rule set, and an age no band holds.
MIXED = Profile(
    id="mixed", label="mixed", age_min=3, age_max=7, bands=PRESCHOOL.bands, quality_filter="pteeth > 3",
    quality_extra=(("3-5", "dteeth > 9"),),
    tables=(
        Table("1", "by age", COUNT_PCT, rows="age", metrics=(Metric("m", "pcaries > 0"),), decimals=1),
        Table("2", "by band", MEAN, rows="band", metrics=(Metric("m", "pteeth"),), decimals=3),
        Table("3", "total", MEAN, rows="none", denominator="all", metrics=(Metric("m", "dmft_p"),)),
    ),
)


@query
def a1_groups_and_total(spark, sf):
    return report(V.prepared(spark, sf, MIXED), MIXED).select(*SHOWN)


@query
def a5_report_school_age(spark, sf):
    return school_long(spark, sf).select(*SHOWN)


@query
def a5_report_preschool(spark, sf):
    return preschool_long(spark, sf).select(*SHOWN)


AREA = ["level", "pvname", "ampname", "hoscode"]


@query
def a5_report_all_areas_school_age(spark, sf):
    return school_long(spark, sf, LEVELS).select(*AREA, *SHOWN)


@query
def a5_report_all_areas_preschool(spark, sf):
    return preschool_long(spark, sf, LEVELS).select(*AREA, *SHOWN)


HEADLINE = ["examined", "qualified", "qualified_pct", "hospitals", "districts", "date_min", "date_max"]


def headlines(profile, levels, columns):
    return lambda spark, sf: areas.headline(cells_of(spark, sf, profile), profile, levels).select(*columns)


register("a6_headline", headlines(SCHOOL_AGE, ["all"], HEADLINE))
register("a6_headline_areas", headlines(PRESCHOOL, ["province", "district"], [*AREA[:3], *HEADLINE]))
register("a7_reconcile", headlines(SCHOOL_AGE, ["all", "province"],
                                   ["level", "pvname", "target", "examined", "examined_pct", "pending",
                                    "out_of_range"]))


def breakdowns(profile, by):
    return lambda spark, sf: areas.breakdown(cells_of(spark, sf, profile), profile, by)


register("a8_district_school_age", breakdowns(SCHOOL_AGE, "district"))
register("a8_district_preschool", breakdowns(PRESCHOOL, "district"))
register("a9_facility_school_age", breakdowns(SCHOOL_AGE, "unit"))
register("a9_facility_preschool", breakdowns(PRESCHOOL, "unit"))

GUM_OVERVIEW = Profile(
    id="gum", label="gum", age_min=6, age_max=12, quality_filter="pteeth > 0", tables=(),
    overview=Overview("gum_status <=> '0'", "gum_sx_1 + gum_sx_2", "healthy gum", "sextants"),
)
register("a10_breakdown_choice", lambda spark, sf: export.breakdown_table(
    breakdowns(GUM_OVERVIEW, "district")(spark, sf), GUM_OVERVIEW))


@query
def a11_area_tree(spark, sf):
    return areas.area_tree(V.records(spark, sf), V.facilities(spark, sf))


@query
def a12_distinct(spark, sf):
    return areas.distinct_values(V.records(spark, sf), "pvname", "ampname", "hostype", facilities=V.facilities(spark, sf))


# Findings ----------------------------------------------------------------------------------

def found(spark, sf, profile):
    return fnd.findings(long_of(spark, sf, profile, ["all", "district"]), profile).withColumn("profile", F.lit(profile.id))


def finding(code):
    def run(spark, sf):
        both = found(spark, sf, SCHOOL_AGE).unionByName(found(spark, sf, PRESCHOOL))
        return both.where(F.col("code") == code).select(
            "profile", "level", "pvname", "ampname", "table_no", "item", "tone", "text")
    return run


for _code, _name in [
    ("I1", "quality_headline"), ("I2", "quality_range"), ("I3", "top_cause"), ("I4", "quality_rows"),
    ("I6", "overall"), ("I7", "trend"), ("I8", "focus"), ("I9", "fastest_step"), ("I10", "top_problem"),
    ("I11", "small_base"), ("I12", "metric_rows"),
]:
    register(f"{_code.lower()}_{_name}", finding(_code))


@query
def i5_primary_metric(spark, sf):
    long = school_long(spark, sf, ["all", "district"])
    chosen = fnd.primary_metrics(SCHOOL_AGE)
    hit = F.lit(False)
    for no, metric in chosen.items():
        hit = hit | ((F.col("table_no") == no) & (F.col("metric") == metric))
    return long.where(hit & F.col("is_total")).select("level", "pvname", "ampname", "table_no", "metric", "value")


@query
def i13_findings_table(spark, sf):
    long = preschool_long(spark, sf)
    return fnd.findings_table(fnd.findings(long, PRESCHOOL), PRESCHOOL)


NO_FINDINGS = Profile(
    id="none", label="none", age_min=0, age_max=12, quality_filter="pteeth > 1000",
    tables=(Table("1", "t", MEAN, rows="none", metrics=(Metric("m", "pteeth"),)),),
)


@query
def i13_no_findings(spark, sf):
    long = long_of(spark, sf, NO_FINDINGS)
    return fnd.findings_table(fnd.findings(long, NO_FINDINGS), NO_FINDINGS)


# Person lists ------------------------------------------------------------------------------

@query
def p1_pending_list(spark, sf):
    return people.pending_list(V.prepared(spark, sf, PRESCHOOL), V.AS_OF)


@query
def p2_failed_list(spark, sf):
    return people.failed_list(V.prepared(spark, sf, SCHOOL_AGE), SCHOOL_AGE, V.AS_OF)


@query
def p3_failed_list_raw(spark, sf):
    df = V.prepared(spark, sf, PRESCHOOL).withColumn("_source_file", F.lit("lineitem.parquet"))
    return people.failed_list(df, PRESCHOOL, V.AS_OF, raw=True)


@query
def p4_sorted_page(spark, sf):
    df = V.prepared(spark, sf, SCHOOL_AGE)
    return people.first_page(people.failed_list(df, SCHOOL_AGE, V.AS_OF, then_by=("cid",))).rows


def pending_page(spark, sf):
    df = V.prepared(spark, sf, SCHOOL_AGE)
    return people.first_page(people.pending_list(df, V.AS_OF, pv="ASIA", then_by=("cid",)), 100)


@query
def p5_pending_page(spark, sf):
    return pending_page(spark, sf).rows


@query
def p5_total(spark, sf):
    return pending_page(spark, sf).counts


def page_walk(first, df: DataFrame, limit: int, pages: int) -> DataFrame:
    """The first pages of a list one after the other, each with its number and the size of the list."""
    out, after = [], None
    for number in range(1, pages + 1):
        page = first(limit, after)
        out += [(*r, number, page.total) for r in page.rows]
        after = page.after
        if after is None:
            break
    schema = ", ".join(f"{sql.name(c)} {kind}" for c, kind in [*df.dtypes, ("page", "int"), ("total", "bigint")])
    return df.sparkSession.createDataFrame(out, schema)


@query
def p5_pending_pages(spark, sf):
    df, options = V.prepared(spark, sf, SCHOOL_AGE), {"pv": "ASIA", "then_by": ("cid",)}
    return page_walk(lambda n, after: people.pending_page(df, V.AS_OF, n, after, **options), people.pending_list(df, V.AS_OF, **options), 40, 3)


@query
def p5_failed_pages(spark, sf):
    df, options = V.prepared(spark, sf, SCHOOL_AGE), {"then_by": ("cid",)}
    return page_walk(lambda n, after: people.failed_page(df, SCHOOL_AGE, V.AS_OF, n, after, **options),
                     people.failed_list(df, SCHOOL_AGE, V.AS_OF, **options), 150, 2)


# Order and sinks ---------------------------------------------------------------------------

def ranked(df: DataFrame) -> DataFrame:
    """Rows with their place in the order they come in."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in [*df.dtypes, ("place", "bigint")])
    return df.sparkSession.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


@query
def o1_breakdown_order(spark, sf):
    return ranked(breakdowns(SCHOOL_AGE, "unit")(spark, sf).select("code", "name", "target"))


@query
def o2_group_order(spark, sf):
    rows = rows_of(spark, sf, SCHOOL_AGE)
    return ranked(wide_table(rows, SCHOOL_AGE, "2").select("อายุ (ปี)", "ฐาน"))


@query
def k1_flat_table_areas(spark, sf):
    rows = rows_of(spark, sf, PRESCHOOL, ["all", "district"])
    return wide_table(rows, PRESCHOOL, "3", with_area=True)


@query
def k2_breakdown_table(spark, sf):
    return export.breakdown_table(breakdowns(PRESCHOOL, "unit")(spark, sf), PRESCHOOL, "unit")


@query
def k3_header_table(spark, sf):
    head = areas.headline(cells_of(spark, sf, SCHOOL_AGE), SCHOOL_AGE, ["all", "district"])
    return export.header_table(head, SCHOOL_AGE, V.AS_OF).drop("hoscode")


@query
def k4_csv(spark, sf):
    path = new_folder(spark, "csv")
    rows = rows_of(spark, sf, SCHOOL_AGE, ["all", "province"])
    sinks.write_csv(wide_table(rows, SCHOOL_AGE, "2", with_area=True).drop("ampname", "hoscode"), path, ["level"])
    return spark.read.option("header", True).option("escape", '"').csv(path)


def bundle_part(spark, sf, part, profile=SCHOOL_AGE, **area):
    path = new_folder(spark, "bundle")
    sinks.write_bundle(cells_of(spark, sf, profile), profile, path, V.AS_OF, **area)
    return sinks.read_part(spark, path, part)


@query
def k5_bundle(spark, sf):
    return bundle_part(spark, sf, "table_5")


@query
def k5_bundle_header(spark, sf):
    return bundle_part(spark, sf, "header").select("ord", "รายการ", "ค่า")


@query
def k5_bundle_districts(spark, sf):
    return bundle_part(spark, sf, "districts", PRESCHOOL)


@query
def k5_bundle_findings(spark, sf):
    return bundle_part(spark, sf, "findings", PRESCHOOL)


@query
def k5_bundle_notes(spark, sf):
    """The notes beside the base of each table's total row."""
    path = new_folder(spark, "bundle")
    sinks.write_bundle(cells_of(spark, sf, PRESCHOOL), PRESCHOOL, path, V.AS_OF)
    notes = sinks.read_part(spark, path, "notes").where("table_no IN ('2', '3')")
    bases = long_of(spark, sf, PRESCHOOL).where("is_total").groupBy("table_no").agg(F.max("base").alias("base"))
    return notes.join(bases, "table_no").select("table_no", "ord", "note", "base")


@query
def k5_bundle_area(spark, sf):
    """The units of a selected district."""
    return bundle_part(spark, sf, "units", PRESCHOOL, pv="ASIA", amp="District 2")


@query
def k5_bundle_area_table(spark, sf):
    return bundle_part(spark, sf, "table_2", PRESCHOOL, pv="ASIA", amp="District 2")


@query
def k6_snapshot(spark, sf):
    folder, root = written_folder(spark, sf), new_folder(spark, "snapshots")
    args = (spark, folder, V.facilities(spark, sf), PRESCHOOL, root)
    snapshot.load_prepared(*args)
    return counted(snapshot.load_prepared(*args), "pvname", "band", "gum_status", "examined")


@query
def k6_changed_files(spark, sf):
    """Files added, changed and removed after a first load; only these are read by the second."""
    return counted(changed_folder(spark, sf, snapshot.load_prepared), "pvname", "band", "gum_status", "examined")


@query
def a1_maintained_cells(spark, sf):
    """Cells of the same files, kept up to date file by file."""
    cells = changed_folder(spark, sf, snapshot.load_cells)
    m = Measures(PRESCHOOL)
    return cells.groupBy("pvname", "ampname").agg(
        F.sum(m.target).alias("target"), F.sum(m.pending).alias("pending"), F.count_distinct("hoscode").alias("units"),
        F.sum(m.examined).alias("in_scope"), F.date_format(F.max("date_max"), "yyyy-MM-dd").alias("last"))


def changed_folder(spark, sf, load_from) -> DataFrame:
    folder, root = new_folder(spark, "records"), new_folder(spark, "snapshots")
    raw = V.text_records(spark, sf)
    pid = F.trim(F.translate("pid", "\u00a0", "")).cast("bigint")
    last = pid % 3 == 2

    def save(part, fmt):
        part.write.mode("append").format(fmt).option("header", True).option("escape", '"').save(folder)

    def load():
        return load_from(spark, folder, V.facilities(spark, sf), PRESCHOOL, root)

    save(raw.where(pid % 3 == 0), "csv")
    save(raw.where(pid % 3 == 1), "parquet")
    named_file(raw.where(pid % 100 == 50), folder, "gone.csv", [])
    named_file(raw.where(last & (pid % 100 == 8)), folder, "_changed.csv", [])
    load()
    drop_folder(spark, f"{folder}/gone.csv")
    drop_folder(spark, f"{folder}/_changed.csv")
    named_file(raw.where(last & (pid % 100 == 7)), folder, "_changed.csv", [""])
    save(raw.where(last & (pid % 100 != 7)), "csv")
    return load()


@query
def k6_rule_change(spark, sf):
    """A changed band, then a changed facility table, each give another snapshot."""
    folder, root = written_folder(spark, sf), new_folder(spark, "snapshots")
    units = V.facilities(spark, sf)
    snapshot.load_prepared(spark, folder, units, PRESCHOOL, root)
    wider = replace(PRESCHOOL, bands=(Band("0-3", 0, 3), Band("4-5", 4, 5)))
    snapshot.load_prepared(spark, folder, units, wider, root)
    moved = units.withColumn("pvname", F.concat(F.lit("new "), "pvname"))
    return counted(snapshot.load_prepared(spark, folder, moved, wider, root), "pvname", "band")
