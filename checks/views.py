"""Exam records and facilities made from the given tables.

One ``lineitem`` row is one record, so the records need no join; ``supplier``, ``nation`` and
``region`` form the facility dimension. The moduli only spread values and blanks about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from molaris.operators.derive import prepare
from molaris.operators.lookup import attach_area, conform_facilities
from molaris.plans.rules import Profile
from molaris.session import tune

AS_OF = "2003-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _code(key: str) -> str:
    return f"lpad(CAST({key} AS STRING), greatest(5, length(CAST({key} AS STRING))), '0')"


DAYS = "((l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31) % 4900 - 200)"
RECORD = {
    "hoscode": f"IF(l_partkey % 211 <> 7, concat(IF(l_suppkey % 17 = 5, 'X', ''), {_code('l_suppkey')}), NULL)",
    "hosname": f"IF(l_orderkey % 2 = 1, concat('Unit ', {_code('l_suppkey')}), NULL)",
    "pid": "CAST(l_orderkey AS STRING)",
    "cid": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "name": "concat('N', l_partkey)",
    "lname": "concat('L', l_orderkey % 1000)",
    "sex": "IF(l_partkey % 89 = 0, NULL, CASE l_linenumber % 3 WHEN 0 THEN '9' WHEN 1 THEN '1' ELSE '2' END)",
    "addr": "concat_ws('/', l_suppkey, l_linenumber)",
    "check_typearea": "IF(l_orderkey % 3 = 0, '1', '3')",
    "birth": f"IF(l_partkey % 193 <> 3, CAST(date_sub(CAST(l_shipdate AS DATE), CAST({DAYS} AS INT)) "
             "AS TIMESTAMP_NTZ), NULL)",
    "date_serv": "IF(l_returnflag = 'N' AND l_linestatus = 'F', NULL, CAST(l_shipdate AS TIMESTAMP_NTZ))",
    "d_update": "CAST(l_shipdate AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, l_orderkey % 86400)",
    "denttype": f"IF({DAYS} < 2190, '2', '3')",
    "providertype": "IF(l_partkey % 61 = 0, NULL, "
                    "CASE l_returnflag WHEN 'A' THEN '02' WHEN 'R' THEN '06' WHEN 'N' THEN '01' END)",
    "gum": "IF(l_partkey % 97 = 0, NULL, CASE l_orderkey % 7 WHEN 0 THEN '000000' WHEN 1 THEN '111111' "
           "WHEN 2 THEN '999999' WHEN 3 THEN '010000' WHEN 4 THEN '30219' WHEN 5 THEN '012399' ELSE '220019' END)",
}
NUMBER = {
    "pteeth": "l_partkey % 29",
    "pcaries": f"IF(l_partkey % 97 = 0, NULL, IF(l_orderkey % 4700 < {DAYS}, l_partkey % 4, 0))",
    "pfilling": "l_suppkey % 3",
    "pextract": "l_partkey % 2",
    "dteeth": "l_orderkey % 22",
    "dcaries": f"IF(l_orderkey % 101 = 0, NULL, IF((l_orderkey * 3) % 4700 < {DAYS}, l_partkey % 4, 0))",
    "dfilling": "l_suppkey % 2",
    "dextract": "l_orderkey % 3",
    "need_fluoride": "l_orderkey % 2 + 1",
    "need_scaling": "IF(l_orderkey % 53 = 0, NULL, l_partkey % 2 + 1)",
    "need_sealant": "l_orderkey % 3",
    "need_pfilling": "IF(l_partkey % 7 = 0, NULL, l_partkey % 3)",
    "need_dfilling": "IF(l_orderkey % 5 = 0, NULL, l_suppkey % 2)",
    "need_pextract": "IF(l_partkey % 11 = 0, NULL, l_suppkey % 5 - 2)",
    "need_dextract": "l_linenumber % 4 - 2",
}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed exam records, one per lineitem row."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        *[f"{x} AS {c}" for c, x in RECORD.items()],
        *[f"CAST({x} AS DOUBLE) AS {c}" for c, x in NUMBER.items()])


def raw_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility rows as delivered: padded codes, numbered area names, some codes twice.

    Records of every 17th supplier carry a code that no facility has.
    """
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    number, sub = "lpad(CAST(n_nationkey AS STRING), 2, '0')", "(s_suppkey % 9)"
    region_code = "lpad(CAST(r_regionkey AS STRING), 2, '0')"
    return (
        supplier.join(nation, F.expr("s_nationkey = n_nationkey"))
        .join(region, F.expr("n_regionkey = r_regionkey"))
        .selectExpr("*", "explode(IF(s_suppkey % 10 = 3, array(0, 1), array(0))) AS copy")
        .selectExpr(
            f"concat({_code('s_suppkey')}, IF(copy = 1, '  ', '')) AS `HOSCODE `",
            "concat(s_name, IF(copy = 1, ' again', '')) AS hosname",
            "concat('type ', s_suppkey % 4) AS hostype",
            "lpad(CAST(n_nationkey AS STRING), 4, '0') AS ampcode",
            f"concat({number}, '-District ', n_nationkey % 20) AS AMPNAME",
            f"{region_code} AS pvcode",
            f"concat({region_code}, '- ', r_name) AS pvname",
            f"concat({number}, {sub}) AS tumcode",
            f"concat({sub}, '-Sub ', {sub}) AS tumbonname",
            "s_acctbal AS unused",
            "copy AS _copy",
        )
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform_facilities(raw_facilities(spark, sf_dir), F.col("_copy"))


def attached(spark: SparkSession, sf_dir: str, broadcast: bool | None = None) -> DataFrame:
    return attach_area(records(spark, sf_dir), facilities(spark, sf_dir), broadcast)


def prepared(spark: SparkSession, sf_dir: str, profile: Profile) -> DataFrame:
    """Records with facility, area, derived columns and the profile's band."""
    return prepare(attached(spark, sf_dir), profile)


def unattached(spark: SparkSession, sf_dir: str, profile: Profile) -> DataFrame:
    """Derived records without the facility join."""
    return prepare(records(spark, sf_dir), profile)


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as dirty text: odd headers, padding, blanks, mixed date layouts."""
    odd = "(CAST(pid AS BIGINT) + CAST(substring_index(cid, '-', -1) AS BIGINT))"
    pid = "CAST(pid AS BIGINT)"

    def dirty(c: str) -> str:
        return (f"CASE WHEN {c} IS NULL THEN CASE {pid} % 3 WHEN 0 THEN '<NA>' WHEN 1 THEN '-' ELSE '' END "
                f"WHEN {pid} % 5 = 1 THEN concat(' ', {c}, '\u00a0') ELSE {c} END")

    def number(c: str) -> str:
        return (f"CASE {odd} % 29 WHEN 0 THEN '5d' WHEN 1 THEN 'N/A' WHEN 2 THEN ' N/A' WHEN 3 THEN '1e1' "
                f"WHEN 4 THEN 'NAN' WHEN 5 THEN '1,000' ELSE {dirty(f'CAST(CAST({c} AS INT) AS STRING)')} END")

    def time(c: str) -> str:
        shown = (f"CASE {pid} % 5 WHEN 0 THEN date_format({c}, 'yyyyMMdd') "
                 f"WHEN 2 THEN date_format({c}, 'yyyy-MM-dd HH:mm:ss') "
                 f"WHEN 3 THEN date_format({c}, 'yyyyMMddHHmmss') ELSE date_format({c}, 'yyyy-MM-dd') END")
        return (f"CASE {odd} % 31 WHEN 0 THEN '2001-02-30' WHEN 1 THEN '2545-01-15' WHEN 2 THEN '15/01/2001' "
                f"WHEN 3 THEN 'null' ELSE {dirty(shown)} END")

    def text(c: str) -> str:
        if c in NUMBER:
            return number(c)
        return time(c) if c in ("birth", "date_serv", "d_update") else dirty(c)

    return records(spark, sf_dir).selectExpr(*[
        f"{text(c)} AS `{' ' + c.upper() if c in ('hoscode', 'pteeth') else c}`" for c in (*RECORD, *NUMBER)])
