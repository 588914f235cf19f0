import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from molaris.functions import numeric, text
from molaris.functions.dates import months_between, years_between
from molaris.functions.gum import gum_status, normal_gum, sextants
from molaris.functions.rule_language import RuleError, kinds_of, to_sql
from molaris.functions.rules import met


def column(spark, values, expression, kind="string"):
    """The expression over a column ``c``, in the order of the values."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r[0] for r in df.selectExpr("i", f"{expression} AS x").orderBy("i").select("x").collect()]


def test_strip_takes_every_unicode_space(spark):
    values = [f"{chr(i)} a b {chr(i)}" for i in range(0x3001) if chr(i).isspace()] + ["", " ", "ก ", " x", "x"]
    assert column(spark, values, text.strip("c")) == [v.strip() for v in values]


def test_null_tokens(spark):
    values = [" - ", "<NA>", "N/A", "NAN", " N/A", "None", "", "x", None]
    assert column(spark, values, text.blank_to_null("c")) == [None, None, None, "NAN", "N/A", None, None, "x", None]


def test_numbers_like_pandas(spark):
    values = ["1e3", "5d", "7", "0x10", "1,000", "-.5", "5.", "abc", "inf", "-Infinity", "1f", "+3", "NAN", "1 2", " 7\u00a0", "\u30008"]
    want = [None if pd.isna(v) else float(v) for v in pd.to_numeric(pd.Series(values).str.strip(), errors="coerce")]
    assert column(spark, values, text.to_number(text.strip("c"))) == want


def test_dates(spark):
    values = ["2026-01-15", "20260115", "2026-01-15 10:11:12", "20260115101112", "2026-02-30", "15/01/2026",
              "2569-01-15", "2026-1-5", "2026+115", None, " 20260115\u00a0", "2262-05-01"]
    shown = column(spark, values, f"date_format({text.valid_time(text.to_time(text.strip('c')))}, 'yyyy-MM-dd HH:mm:ss')")
    day, clock = "2026-01-15 00:00:00", "2026-01-15 10:11:12"
    assert shown == [day, day, clock, clock, None, None, None, None, None, None, day, None]


def test_prefix_and_file_name(spark):
    assert column(spark, ["01-Name", "๑๒-ชื่อ ", "Name"], text.drop_number_prefix("c")) == ["Name", "ชื่อ", "Name"]
    assert column(spark, ["a%200-2%20+b.csv", "x%25.csv"], text.file_name("c")) == ["a 0-2 +b.csv", "x%.csv"]


@pytest.mark.parametrize("birth, at, years, months", [
    ("2016-02-29", "2022-02-28", 5, 71), ("2022-01-31", "2022-02-28", 0, 0), ("2022-02-01", "2022-01-01", -1, -1),
    ("2016-03-01", "2022-03-01", 6, 72),
])
def test_age(spark, birth, at, years, months):
    b, a = f"DATE '{birth}'", f"DATE '{at}'"
    row = spark.range(1).selectExpr(years_between(b, a), months_between(b, a)).first()
    assert tuple(row) == (years, months)


def test_gum(spark):
    values = ["309999", "abc123", "30219", "", None]
    normal = column(spark, values, normal_gum("c"))
    assert normal == ["309999", "abc123", "999999", None, None]
    assert column(spark, normal, gum_status("c")) == ["3", "3", "9", None, None]
    assert column(spark, normal, sextants("c", "9")) == [4, 0, 6, None, None]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(min_value=-1e7, max_value=1e7, allow_nan=False), min_size=1, max_size=2000))
def test_rounding_like_python(spark, values):
    values += [0.125, 2.675, 0.5, 1.5, 2.5, 1e300, -0.125] + [100 * n / d for n in range(40) for d in (7, 16, 64)]
    for places in (0, 1, 2, 3):
        got = column(spark, values, numeric.round_half_even("c", places), "double")
        assert got == [round(v, places) for v in values]


def test_ratio_without_base(spark):
    row = spark.sql(f"SELECT {numeric.percent('1', '0')}, {numeric.scaled_percent('CAST(NULL AS DOUBLE)')}").first()
    assert tuple(row) == (None, 0.0)


def test_rule_null_semantics(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) AS s, CAST(NULL AS DOUBLE) AS d, 1D AS e")
    cases = {"s <=> 'a'": False, "NOT (s <=> 'a')": True, "NOT coalesce(s IN ('a'), false)": True, "d + e = 0": False,
             "d > 0 OR e > 0": True, "d > 0": False}
    assert [df.selectExpr(met(r)).first()[0] for r in cases] == list(cases.values())
    assert met(None) == "true" and met(False) == "false"


def test_rules_by_the_types_of_their_columns(spark):
    """As the reference evaluates them: a text never equals a number, two null texts are neither equal nor unequal."""
    df = spark.createDataFrame(
        [("x", "x", 1.0, 1.0), ("x", "y", 2.0, None), (None, "x", None, None), (None, None, 4.0, 3.0), ("1", None, 1.0, 5.0)],
        "a string, b string, n double, m double")
    kinds = kinds_of(df.dtypes)
    cases = {
        "a == b": [1, 0, 0, 0, 0], "a != b": [0, 1, 0, 0, 0], "not (a == b)": [0, 1, 0, 0, 0], "a == 'x'": [1, 1, 0, 0, 0],
        "a != 'x'": [0, 0, 1, 1, 1], "a < b": [0, 1, 0, 0, 0], "a == 1": [0, 0, 0, 0, 0], "a != 1": [1, 1, 0, 0, 1],
        "a == n": [0, 0, 0, 0, 0], "a != n": [1, 1, 0, 0, 1], "n == 'x'": [0, 0, 0, 0, 0], "n != 'x'": [1, 1, 1, 1, 1],
        "a + b == 'xx'": [1, 0, 0, 0, 0], "a + b != 'xx'": [0, 1, 1, 1, 1], "n == m": [1, 0, 0, 0, 0], "n != m": [0, 0, 0, 1, 1],
        "n in [1, 'x']": [1, 0, 0, 0, 1], "a in [1]": [0, 0, 0, 0, 0], "a not in [1]": [1, 1, 1, 1, 1], "(n == 1) == (m == 1)": [1, 0, 0, 1, 0],
    }
    got = df.selectExpr(*[f"{met(to_sql(rule, kinds))} AS c{i}" for i, rule in enumerate(cases)]).collect()
    for i, (rule, expected) in enumerate(cases.items()):
        assert [int(r[i]) for r in got] == expected, rule
    for rule, wrong in {"z == 1": "no column z", "a > 1": "order of a text and a number", "a - b == 1": "arithmetic with a text",
                        "a + 1 == 2": "arithmetic with a text"}.items():
        with pytest.raises(RuleError, match=wrong):
            to_sql(rule, kinds)
    assert to_sql("z == 1") == "(`z` = 1)" and to_sql("pteeth == '3'") == "false"
