"""The same queries as SQL, written apart from the library."""

from __future__ import annotations

AS_OF = "2003-06-30"
ORACLE: dict[str, str] = {}

# ------------------------------------------------------------------------------------------
# The records, facilities and derived columns

CODE = "lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0')"

EXAM = f"""
keyed AS (
  SELECT *, l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n,
         (l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31) % 4900 - 200 AS days, {CODE} AS unit
  FROM lineitem),
exam AS (
  SELECT CASE WHEN p % 211 = 7 THEN NULL WHEN s % 17 = 5 THEN 'X' || unit ELSE unit END AS hoscode,
    CASE WHEN o % 2 = 1 THEN 'Unit ' || unit END AS hosname,
    CAST(o AS VARCHAR) AS pid, concat_ws('-', o, n, p, s) AS cid,
    'N' || p AS name, 'L' || (o % 1000) AS lname,
    CASE WHEN p % 89 = 0 THEN NULL WHEN n % 3 = 1 THEN '1' WHEN n % 3 = 2 THEN '2' ELSE '9' END AS sex,
    s || '/' || n AS addr, CASE WHEN o % 3 = 0 THEN '1' ELSE '3' END AS check_typearea,
    CASE WHEN p % 193 <> 3 THEN CAST(CAST(l_shipdate AS DATE) - CAST(days AS INTEGER) AS TIMESTAMP) END AS birth,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL ELSE l_shipdate END AS date_serv,
    l_shipdate + to_seconds(o % 86400) AS d_update,
    CASE WHEN days < 2190 THEN '2' ELSE '3' END AS denttype,
    CASE WHEN p % 61 <> 0 THEN
      CASE l_returnflag WHEN 'A' THEN '02' WHEN 'R' THEN '06' WHEN 'N' THEN '01' END END AS providertype,
    CAST(p % 29 AS DOUBLE) AS pteeth,
    CASE WHEN p % 97 <> 0 THEN CAST(CASE WHEN o % 4700 < days THEN p % 4 ELSE 0 END AS DOUBLE) END AS pcaries,
    CAST(s % 3 AS DOUBLE) AS pfilling, CAST(p % 2 AS DOUBLE) AS pextract,
    CAST(o % 22 AS DOUBLE) AS dteeth,
    CASE WHEN o % 101 <> 0 THEN CAST(CASE WHEN (o * 3) % 4700 < days THEN p % 4 ELSE 0 END AS DOUBLE) END AS dcaries,
    CAST(s % 2 AS DOUBLE) AS dfilling, CAST(o % 3 AS DOUBLE) AS dextract,
    CAST(o % 2 + 1 AS DOUBLE) AS need_fluoride,
    CASE WHEN o % 53 <> 0 THEN CAST(p % 2 + 1 AS DOUBLE) END AS need_scaling,
    CAST(o % 3 AS DOUBLE) AS need_sealant,
    CASE WHEN p % 7 <> 0 THEN CAST(p % 3 AS DOUBLE) END AS need_pfilling,
    CASE WHEN o % 5 <> 0 THEN CAST(s % 2 AS DOUBLE) END AS need_dfilling,
    CASE WHEN p % 11 <> 0 THEN CAST(s % 5 - 2 AS DOUBLE) END AS need_pextract,
    CAST(n % 4 - 2 AS DOUBLE) AS need_dextract,
    CASE WHEN p % 97 <> 0 THEN CASE o % 7 WHEN 0 THEN '000000' WHEN 1 THEN '111111' WHEN 2 THEN '999999'
      WHEN 3 THEN '010000' WHEN 4 THEN '30219' WHEN 5 THEN '012399' WHEN 6 THEN '220019' END END AS gum
  FROM keyed)"""

FACILITY = """
fac AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS hoscode,
    s_name AS hosname, 'type ' || (s_suppkey % 4) AS hostype,
    lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS ampcode, 'District ' || (n_nationkey % 20) AS ampname,
    lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS pvcode, r_name AS pvname,
    lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || (s_suppkey % 9) AS tumcode, 'Sub ' || (s_suppkey % 9) AS tumbonname
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ATTACHED = f"""{EXAM},{FACILITY},
att AS (
  SELECT e.* REPLACE (coalesce(e.hosname, f.hosname) AS hosname), f.hosname AS hosname_ref, f.hostype, f.ampcode,
    coalesce(f.ampname, 'ไม่ระบุ') AS ampname, f.pvcode, coalesce(f.pvname, 'ไม่ระบุ') AS pvname,
    f.tumcode, f.tumbonname
  FROM exam e LEFT JOIN fac f ON e.hoscode = f.hoscode)"""


def age_of(birth: str, at: str) -> str:
    return (f"(year({at}) - year({birth}) - CASE WHEN month({at}) * 100 + day({at}) < "
            f"month({birth}) * 100 + day({birth}) THEN 1 ELSE 0 END)")


def derived_from(source: str) -> str:
    return f"""
prep AS (
  SELECT *, CASE WHEN age BETWEEN 0 AND 2 THEN '0-2' WHEN age BETWEEN 3 AND 5 THEN '3-5' END AS band,
    CASE gum_status WHEN '0' THEN 'ปกติ' WHEN '1' THEN 'เลือดออก' WHEN '2' THEN 'เหงือกอักเสบ/หินน้ำลาย'
      WHEN '3' THEN 'ปริทันต์อักเสบ' WHEN '9' THEN 'ตรวจไม่ได้' END AS gum_label
  FROM (
    SELECT *, {age_of('birth', 'date_serv')} AS age,
      (year(date_serv) - year(birth)) * 12 + month(date_serv) - month(birth)
        - CASE WHEN day(date_serv) < day(birth) THEN 1 ELSE 0 END AS age_month,
      date_serv IS NOT NULL AS examined,
      {", ".join(f"len(list_filter(string_split(g, ''), lambda c: c = '{c}')) AS gum_sx_{c}" for c in "01239")},
      CASE WHEN g IS NOT NULL THEN
        coalesce(list_max(list_filter(string_split(g, ''), lambda c: c IN ('0','1','2','3'))), '9') END AS gum_status,
      CASE WHEN coalesce(pcaries, pfilling, pextract) IS NOT NULL THEN
        coalesce(pcaries, 0) + coalesce(pfilling, 0) + coalesce(pextract, 0) END AS dmft_p,
      CASE WHEN coalesce(dcaries, dfilling, dextract) IS NOT NULL THEN
        coalesce(dcaries, 0) + coalesce(dfilling, 0) + coalesce(dextract, 0) END AS dmft_d
    FROM (SELECT *, CASE WHEN gum IS NULL OR trim(gum) = '' THEN NULL
                         WHEN length(trim(gum)) = 6 THEN trim(gum) ELSE '999999' END AS g FROM {source})))"""


PREPARED = f"{ATTACHED},{derived_from('att')}"
DERIVED = f"{EXAM},{derived_from('exam')}"


def rounded(x: str, places: int = 2) -> str:
    """Half-even of the exact binary value, for x >= 0."""
    s = 10 ** places
    parity = "k % 2 = 1" if places else "hi % 2 = 1"
    return (
        f"list_transform([CAST({x} AS DOUBLE)], lambda x: list_transform([{{'hi': floor(x), 'lo': x - floor(x)}}], "
        f"lambda a: list_transform([{{'hi': a.hi, 'lo': a.lo, 'k': CAST(floor({s} * a.lo) AS BIGINT), "
        f"'h': floor(a.lo * 67108864) / 67108864}}], lambda b: list_transform([{{'hi': b.hi, 'k': b.k, "
        f"'t': ({2 * s} * b.h - (2 * b.k + 1)) + {2 * s} * (b.lo - b.h)}}], lambda c: "
        f"({s} * c.hi + c.k + CASE WHEN c.t > 0 OR (c.t = 0 AND c.{parity}) THEN 1 ELSE 0 END) / {s})[1])[1])[1])[1]"
    )


def pct(n: str, d: str, places: int = 2) -> str:
    return rounded(f"100.0::DOUBLE * ({n}) / nullif({d}, 0)", places)


def mean(total: str, d: str, places: int = 2) -> str:
    return rounded(f"({total}) / nullif({d}, 0)", places)


def text(x: str, places: int = 2) -> str:
    """Number as shown in sentences."""
    if places == 0:
        return f"coalesce(format('{{:,}}', CAST({rounded(x, 0)} AS BIGINT)), '-')"
    return f"coalesce(format('{{:,.{places}f}}', {rounded(x, places)}), '-')"


def scaled(x: str) -> str:
    """rint(100 x) / 100 of a number >= 0."""
    y = f"(({x}) * 100)"
    return (f"(floor({y}) + CASE WHEN {y} - floor({y}) > 0.5 OR ({y} - floor({y}) = 0.5 "
            f"AND floor({y}) % 2 = 1) THEN 1 ELSE 0 END) / 100")


def counted(cte: str, source: str, columns: str, where: str = "true") -> str:
    return f"WITH {cte} SELECT {columns}, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL"


# ------------------------------------------------------------------------------------------
# Rule sets, in SQL

P3 = "pcaries + pfilling + pextract"
D3 = "dcaries + dfilling + dextract"
SCHOOL = {
    "id": "6-12y", "label": "เด็กวัยเรียน 6-12 ปี", "min": 6, "max": 12, "rows": "age",
    "quality": "coalesce(providertype IN ('02', '06') AND pteeth > 0, false)",
    "cf": f"{P3} = 0", "dmft": P3,
    "checks": [("provider_type in (02,06)", "providertype IN ('02', '06')", "true"),
               ("PTEETH > 0", "pteeth > 0", "true")],
    "tables": [
        ("1", "quality", []),
        ("2", "count_pct", [("ปราศจากฟันผุ", f"{P3} = 0"), ("ฟันดีไม่มีผุ", "pcaries + pextract = 0"),
                            ("ฟันผุไม่ได้รักษา", "pcaries > 0"), ("ฟันถอน", "pextract > 0"),
                            ("ฟันอุด", "pfilling > 0"), ("ฟันผุถอนอุด", f"{P3} > 0")]),
        ("3", "mean", [("ฟันที่มีในปาก", "pteeth"), ("ฟันผุ", "pcaries"), ("ฟันถอน", "pextract"),
                       ("ฟันอุด", "pfilling"), ("ฟันผุถอนอุด", P3)]),
        ("4", "count_pct", [("ปกติ", "gum_status = '0'"), ("เลือดออก", "gum_status = '1'"),
                            ("เหงือกอักเสบ", "gum_status = '2'"), ("ปริทันต์", "gum_status = '3'"),
                            ("ตรวจไม่ได้", "gum_status = '9'")]),
        ("5", "mean", [("ปกติ", "gum_sx_0"), ("เลือดออก", "gum_sx_1"), ("เหงือกอักเสบ", "gum_sx_2"),
                       ("ปริทันต์", "gum_sx_3"), ("ตรวจไม่ได้", "gum_sx_9")]),
        ("6", "count_pct", [("ทาฟลูออไรด์", "need_fluoride = 1"), ("เคลือบหลุมร่องฟัน", "need_sealant > 0"),
                            ("อุดฟัน", "need_pfilling > 0 OR need_dfilling > 0"),
                            ("ถอนฟัน/รักษารากฟัน", "need_pextract > 0 OR need_dextract > 0"),
                            ("ขูดหินปูน", "need_scaling = 1")]),
    ],
}
PRESCHOOL = {
    "id": "0-5y", "label": "เด็กก่อนวัยเรียน 0-5 ปี", "min": 0, "max": 5, "rows": "band",
    "quality": ("coalesce(providertype IN ('02', '06') AND dteeth >= 1 AND dteeth <= 20 "
                f"AND {D3} <= 20, false) AND (band <> '3-5' OR coalesce(dteeth + dextract = 20, false))"),
    "cf": f"{D3} = 0", "dmft": D3,
    "checks": [("provider_type in (02,06)", "providertype IN ('02', '06')", "true"),
               ("dteeth between 1-20", "dteeth BETWEEN 1 AND 20", "true"),
               ("dcaries+dfilling+dextract <= 20", f"{D3} <= 20", "true"),
               ("dteeth+dextract = 20 (เฉพาะ 3-5 ปี)", "dteeth + dextract = 20", "coalesce(band = '3-5', false)")],
    "tables": [
        ("1", "quality", []),
        ("2", "count_pct", [("ปราศจากฟันผุ", f"{D3} = 0"), ("ฟันดีไม่มีผุ", "dcaries + dextract = 0"),
                            ("ฟันผุไม่ได้รักษา", "dcaries > 0"), ("ฟันถอน", "dextract > 0"),
                            ("ฟันอุด", "dfilling > 0"), ("ฟันผุถอนอุด", f"{D3} > 0")]),
        ("3", "mean", [("ฟันที่มีในปาก", "dteeth"), ("ฟันผุ", "dcaries"), ("ฟันถอน", "dextract"),
                       ("ฟันอุด", "dfilling"), ("ฟันผุถอนอุด", D3)]),
        ("7", "count_pct", [("ทาฟลูออไรด์", "need_fluoride = 1"), ("เคลือบหลุมร่องฟัน", "need_sealant > 0"),
                            ("อุดฟัน", "need_dfilling > 0"), ("ถอนฟัน/รักษารากฟัน", "need_dextract > 0"),
                            ("ขูดหินปูน", "need_scaling = 1")]),
    ],
}

LEVELS = {
    "all": (), "province": ("pvname",), "district_name": ("ampname",), "district": ("pvname", "ampname"),
    "facility_code": ("hoscode",), "facility": ("pvname", "ampname", "hoscode"),
}
AREA = ("pvname", "ampname", "hoscode")


def scoped(ps: dict) -> str:
    """Population with in_scope and q."""
    return (f"pop AS (SELECT *, coalesce(examined AND age BETWEEN {ps['min']} AND {ps['max']}, false) AS in_scope, "
            f"{ps['quality']} AS q FROM prep)")


def spine(ps: dict) -> str:
    rows = ([(a, str(a)) for a in range(ps["min"], ps["max"] + 1)] if ps["rows"] == "age"
            else [(0, "0-2"), (1, "3-5")])
    values = ", ".join(f"({i}, '{label}', false)" for i, label in rows)
    return f"spine AS (SELECT * FROM (VALUES {values}, (1000, 'รวม', true)) v(row_ord, row_label, is_total))"


def level_areas(levels) -> str:
    """One row per level and area of the population."""
    parts = []
    for level in levels:
        keys = LEVELS[level]
        shown = ", ".join(k if k in keys else f"CAST(NULL AS VARCHAR) AS {k}" for k in AREA)
        parts.append(f"SELECT DISTINCT '{level}' AS level, {shown} FROM prep")
    return "areas AS (" + " UNION ALL ".join(parts) + ")"


def long_ctes(ps: dict, levels=("all",)) -> str:
    """CTE ``long``: a row per area, table, group and metric, by brute force."""
    row_match = ("age = s.row_ord" if ps["rows"] == "age" else "band = s.row_label")
    figures = []
    for i, (no, kind, metrics) in enumerate(ps["tables"]):
        if kind == "quality":
            figures.append((i, no, kind, 0, "pass", "จำนวนที่ผ่านเกณฑ์คุณภาพ", "true", "coalesce(q, false)", None))
            for j, (name, rule, applies) in enumerate(ps["checks"], 1):
                figures.append((i, no, kind, j, "check", name, applies,
                                f"{applies} AND NOT coalesce({rule}, false)", None))
        for j, (name, rule) in enumerate(metrics):
            if kind == "mean":
                figures.append((i, no, kind, j, "metric", name, "q", None, rule))
            elif kind == "count_pct":
                figures.append((i, no, kind, j, "metric", name, "q", f"q AND ({rule})", None))
    parts = []
    for level in levels:
        match = " AND ".join([f"r.{k} IS NOT DISTINCT FROM a.{k}" for k in LEVELS[level]] or ["true"])
        aggregates = []
        for f, (_, _, _, _, _, _, base, count, value) in enumerate(figures):
            aggregates.append(f"count(*) FILTER (WHERE in_scope AND {base}) AS b{f}")
            aggregates.append(f"count(*) FILTER (WHERE in_scope AND {count}) AS n{f}" if count
                              else f"coalesce(sum(CASE WHEN in_scope AND q THEN {value} END), 0)::DOUBLE AS t{f}")
        row = "age" if ps["rows"] == "age" else "band"
        keys = ", ".join(f"{k}" for k in LEVELS[level])
        parts.append((level, keys, row, match, aggregates))
    ctes = [PREPARED, scoped(ps), spine(ps), level_areas(levels)]
    wides = []
    for level, keys, row, match, aggregates in parts:
        group = f"GROUP BY GROUPING SETS (({keys + ', ' if keys else ''}rowkey), ({keys}))"
        source = f"(SELECT *, CASE WHEN in_scope THEN CAST({row} AS VARCHAR) END AS rowkey FROM pop)"
        select = ", ".join([k for k in LEVELS[level]] + ["rowkey", "grouping(rowkey) AS total_row"] + aggregates)
        ctes.append(f"g_{level} AS (SELECT {select} FROM {source} {group})")
        shown = ", ".join(f"coalesce(b{f}, 0) AS b{f}, " + (f"coalesce(n{f}, 0) AS n{f}" if fig[7] else
                          f"coalesce(t{f}, 0.0::DOUBLE) AS t{f}") for f, fig in enumerate(figures))
        wides.append(
            f"SELECT a.level, a.pvname, a.ampname, a.hoscode, s.row_ord, s.row_label, s.is_total, {shown} "
            f"FROM areas a JOIN spine s ON true LEFT JOIN g_{level} r ON {match} AND "
            f"((s.is_total AND r.total_row = 1) OR (NOT s.is_total AND r.total_row = 0 AND r.rowkey = s.row_label)) "
            f"WHERE a.level = '{level}'")
    ctes.append("wide AS (" + " UNION ALL ".join(wides) + ")")
    longs = []
    for f, (i, no, kind, j, role, name, _, count, _) in enumerate(figures):
        n = f"CAST(n{f} AS BIGINT)" if count else "CAST(NULL AS BIGINT)"
        t = "CAST(NULL AS DOUBLE)" if count else f"t{f}"
        v = pct(f"n{f}", f"b{f}") if count else mean(f"t{f}", f"b{f}")
        longs.append(f"SELECT level, pvname, ampname, hoscode, row_ord, row_label, is_total, {i} AS table_ord, "
                     f"'{no}' AS table_no, '{kind}' AS kind, '{role}' AS role, {j} AS metric_ord, '{name}' AS metric, "
                     f"b{f} AS base, {n} AS n, {t} AS total, {v} AS value FROM wide")
    ctes.append("long AS (" + " UNION ALL ".join(longs) + ")")
    return ",\n".join(ctes)


# ------------------------------------------------------------------------------------------
# Dirty text

NUMBERS = ["pteeth", "pcaries", "pfilling", "pextract", "dteeth", "dcaries", "dfilling", "dextract",
           "need_fluoride", "need_scaling", "need_sealant", "need_pfilling", "need_dfilling",
           "need_pextract", "need_dextract"]
TIMES = ["birth", "date_serv", "d_update"]
TEXTS = ["hoscode", "hosname", "pid", "cid", "name", "lname", "sex", "addr", "check_typearea", "denttype",
         "providertype", "gum"]


def dirty(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN CASE po % 3 WHEN 0 THEN '<NA>' WHEN 1 THEN '-' ELSE '' END "
            f"WHEN po % 5 = 1 THEN ' ' || {c} || chr(160) ELSE {c} END")


def dirty_number(c: str) -> str:
    plain = f"CAST(CAST({c} AS INTEGER) AS VARCHAR)"
    return (f"CASE (po + un) % 29 WHEN 0 THEN '5d' WHEN 1 THEN 'N/A' WHEN 2 THEN ' N/A' WHEN 3 THEN '1e1' "
            f"WHEN 4 THEN 'NAN' WHEN 5 THEN '1,000' ELSE {dirty(plain)} END")


def dirty_time(c: str) -> str:
    shown = (f"CASE po % 5 WHEN 0 THEN strftime({c}, '%Y%m%d') WHEN 2 THEN strftime({c}, '%Y-%m-%d %H:%M:%S') "
             f"WHEN 3 THEN strftime({c}, '%Y%m%d%H%M%S') ELSE strftime({c}, '%Y-%m-%d') END")
    return (f"CASE (po + un) % 31 WHEN 0 THEN '2001-02-30' WHEN 1 THEN '2545-01-15' WHEN 2 THEN '15/01/2001' "
            f"WHEN 3 THEN 'null' ELSE {dirty(shown)} END")


TOKENS = "('<NA>', '<null>', '<NULL>', 'NULL', 'null', 'NaN', 'nan', '', '-')"
FILE_TOKENS = ("('#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', "
               "'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null', '')")


def blank(c: str) -> str:
    return f"CASE WHEN {c} NOT IN {FILE_TOKENS} AND trim({c}) NOT IN {TOKENS} THEN trim({c}) END"


def to_number(c: str) -> str:
    number = f"try_cast({blank(c)} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({number}) THEN {number} END"


def to_time(c: str) -> str:
    b = blank(c)
    parsed = f"try_strptime({b}, ['%Y-%m-%d', '%Y%m%d', '%Y-%m-%d %H:%M:%S', '%Y%m%d%H%M%S'])"
    return f"CASE WHEN {parsed} < TIMESTAMP '2262-04-12' THEN {parsed} END"


TEXT = f"""{EXAM},
txt AS (SELECT {", ".join([f"{dirty(c)} AS {c}" for c in TEXTS] + [f"{dirty_number(c)} AS {c}" for c in NUMBERS]
                          + [f"{dirty_time(c)} AS {c}" for c in TIMES])}, po
  FROM (SELECT *, CAST(pid AS BIGINT) AS po, CAST(split_part(cid, '-', 4) AS BIGINT) AS un FROM exam)),
clean AS (SELECT {", ".join([f"{blank(c)} AS {c}" for c in TEXTS]
                            + [f"{to_number(c)} AS {c}" for c in NUMBERS]
                            + [f"{to_time(c)} AS {c}" for c in TIMES])}, po FROM txt)"""

# ------------------------------------------------------------------------------------------
# Sources and cleaning

ORACLE["s1_folder_scan"] = f"""WITH {TEXT}
SELECT CASE WHEN po % 3 = 2 THEN CASE WHEN po % 2 = 0 THEN 'x' ELSE '1' END END AS extra, count(*) AS n,
  count(*) FILTER (WHERE po % 3 <> 2 AND po % 7 = 0) AS broken,
  count(DISTINCT CASE WHEN po % 3 <> 2 AND po % 7 = 0 THEN replace(addr, '/', chr(10)) ELSE addr END) AS addresses, count(hoscode) AS hoscodes,
  count(CASE WHEN po % 3 <> 1 THEN gum END) AS gums, count(birth) AS births, count(date_serv) AS served,
  sum(pteeth) AS pteeth, count(DISTINCT cid) AS persons
FROM clean GROUP BY ALL"""
ORACLE["s1_ranges"] = f"""WITH {TEXT}, shown AS (SELECT * REPLACE (CASE WHEN po % 3 <> 1 THEN gum END AS gum) FROM clean WHERE po % 3 <> 2)
SELECT gum IS NULL AS no_gum, count(*) AS n, count(*) FILTER (WHERE po % 7 = 0) AS broken,
  count(DISTINCT CASE WHEN po % 7 = 0 THEN replace(addr, '/', chr(10)) ELSE addr END) AS addresses, count(hoscode) AS hoscodes,
  count(birth) AS births, sum(pteeth) AS pteeth, count(DISTINCT cid) AS persons
FROM shown GROUP BY ALL"""
ORACLE["s2_source_file"] = f"""WITH {EXAM}
SELECT CASE WHEN CAST(pid AS BIGINT) % 3 = 2 THEN 'parquet' ELSE 'csv' END AS kind,
  CAST(pid AS BIGINT) % 3 <> 0 OR CAST(pid AS BIGINT) % 50 <> 0 AS plain, count(*) AS n
FROM exam GROUP BY ALL"""
ORACLE["s3_facilities"] = f"WITH {FACILITY} SELECT * FROM fac"
ORACLE["s3_facilities_thai"] = f"WITH {FACILITY} SELECT hoscode, 'โรงพยาบาลฯ๑ ' || hosname AS hosname, ampname FROM fac"
ORACLE["s4_dictionary"] = """SELECT 'field_' || p_partkey AS name, p_name AS caption,
  p_brand || ', "' || p_type || '"' AS description FROM part"""
ORACLE["u1_append_by_name"] = """SELECT s, m, count(*) AS n FROM (
  SELECT o_orderkey AS id, o_orderstatus AS s, NULL AS m FROM orders
  UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer) GROUP BY ALL"""

ORACLE["n1_headers"] = f"WITH {TEXT} SELECT hoscode, count(pteeth) AS n FROM txt GROUP BY ALL"
ORACLE["n2_null_tokens"] = f"WITH {TEXT} SELECT {blank('pteeth')} AS value, count(*) AS n FROM txt GROUP BY ALL"
ORACLE["n3_numeric"] = counted(TEXT, "clean", "pteeth, need_pextract")
ORACLE["n4_dates"] = counted(
    TEXT, "clean", "strftime(date_serv, '%Y-%m-%d %H:%M:%S') AS date_serv, "
    "strftime(date_trunc('month', birth), '%Y-%m-%d 00:00:00') AS birth_month")
ORACLE["n4_birth_days"] = counted(TEXT, "clean", "strftime(birth, '%Y-%m-%d') AS birth")
ORACLE["n4_layouts"] = counted(
    TEXT, "txt", f"CASE WHEN date_serv = '15/01/2001' THEN '2001-01-15' "
    f"ELSE strftime({to_time('date_serv')}, '%Y-%m-%d') END AS date_serv")
ORACLE["n4_unparsed"] = f"WITH {TEXT} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE ({blank(c)}) IS NOT NULL AND ({read(c)}) IS NULL) AS values FROM txt"
    for columns, read in ((NUMBERS, to_number), (TIMES, to_time)) for c in columns)
ORACLE["n5_codes"] = counted(TEXT, "clean", "hoscode, providertype, sex")
ORACLE["n6_filename_rules"] = f"""WITH {EXAM},
named AS (SELECT *, CASE CAST(pid AS BIGINT) % 4 WHEN 0 THEN 'Exam 0-2 YEARS.csv' WHEN 1 THEN 'exam 3-5.csv'
  WHEN 2 THEN '3-5 and 0-2.csv' ELSE 'other.csv' END AS f FROM exam),
ruled AS (SELECT *, CASE WHEN f LIKE '%0-2%' THEN 'a0-2' WHEN f LIKE '%3-5%' THEN 'a3-5' END AS agegroup,
  CASE WHEN lower(f) LIKE '%0-2 years%' THEN 'young' WHEN f LIKE '%3-5%' THEN 'older' END AS r FROM named)
SELECT f AS _source_file, agegroup, coalesce(r, 'unrated') AS rated, coalesce(sex, r) AS sex, r AS denttype,
  count(*) AS n FROM ruled GROUP BY ALL"""
ORACLE["n7_prefix_strip"] = """SELECT 'District ' || (n_nationkey % 20) AS amp, r_name AS pv,
  sum(CASE WHEN s_suppkey % 10 = 3 THEN 2 ELSE 1 END)::BIGINT AS n
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL"""
ORACLE["n8_first_per_key"] = f"""WITH {EXAM}
SELECT hoscode, cid, strftime(birth, '%Y-%m-%d') AS birth, gum FROM (
  SELECT *, row_number() OVER (PARTITION BY hoscode ORDER BY birth NULLS FIRST, cid) AS rn
  FROM exam WHERE hoscode IS NOT NULL) WHERE rn = 1"""
for _key in ("j1_facility_lookup", "j1_facility_lookup_salted"):
    ORACLE[_key] = counted(ATTACHED, "att", "hoscode, hosname, hosname_ref, hostype, ampcode, ampname, pvname, tumbonname")
ORACLE["j2_spine"] = f"""WITH {PREPARED},
q AS (SELECT *, examined AND age BETWEEN 0 AND 14
        AND pteeth > 26 AND dteeth > 18 AS ok FROM prep),
spine AS (SELECT CAST(range AS VARCHAR) AS row_label FROM range(15) UNION ALL SELECT 'รวม'),
area AS (SELECT 'all' AS level, CAST(NULL AS VARCHAR) AS hoscode UNION ALL
         SELECT DISTINCT 'facility_code', hoscode FROM prep)
SELECT level, a.hoscode, row_label, count(q.pid) AS base, count(q.pid) FILTER (WHERE pcaries > 0) AS n,
  {pct("count(q.pid) FILTER (WHERE pcaries > 0)", "count(q.pid)")} AS value
FROM area a JOIN spine ON true
LEFT JOIN q ON q.ok AND (level = 'all' OR q.hoscode IS NOT DISTINCT FROM a.hoscode)
  AND (row_label = 'รวม' OR CAST(age AS VARCHAR) = row_label)
GROUP BY level, a.hoscode, row_label"""
ORACLE["j3_vs_total"] = f"""WITH {long_ctes(SCHOOL, ("all", "district"))}
SELECT * EXCLUDE (is_total), value - total_value AS gap FROM (
  SELECT level, pvname, ampname, table_no, row_label, metric, value, is_total,
    max(value) FILTER (WHERE is_total) OVER (PARTITION BY level, pvname, ampname, table_no, metric_ord) AS total_value
  FROM long) WHERE NOT is_total"""

# ------------------------------------------------------------------------------------------
# Derived columns

for _key, _columns in {
    "d1_age_years": "age", "d2_age_months": "age_month", "d3_examined": "examined",
    "d5_gum_status": "gum, gum_status",
    "d6_gum_sextants": "gum, gum_sx_0, gum_sx_1, gum_sx_2, gum_sx_3, gum_sx_9",
    "d7_gum_label": "gum_status, gum_label", "d8_indices": "dmft_p, dmft_d", "d9_band": "age, band",
}.items():
    ORACLE[_key] = counted(DERIVED, "prep", _columns)
ORACLE["d4_gum_normal"] = f"""WITH {TEXT} SELECT CASE WHEN length(trim(gum)) = 6 THEN trim(gum)
  WHEN trim(gum) <> '' THEN '999999' ELSE '' END AS gum, count(*) AS n FROM txt GROUP BY 1"""

SEX = "CASE sex WHEN '1' THEN 'ชาย' WHEN '2' THEN 'หญิง' ELSE sex END"
PROVIDER = ("CASE WHEN providertype = '02' THEN 'ทันตแพทย์' WHEN providertype = '06' THEN 'ทันตาภิบาล' "
            "WHEN providertype IS NULL THEN 'ไม่ระบุ' ELSE 'อื่น ๆ (' || providertype || ')' END")
TODAY = age_of("birth", f"DATE '{AS_OF}'")
ORACLE["d10_age_today"] = counted(EXAM, "exam", f"{TODAY} AS age_today")
ORACLE["d11_sex_label"] = counted(EXAM, "exam", f"sex, {SEX} AS sex_label")
ORACLE["d12_provider_label"] = counted(EXAM, "exam", f"providertype, {PROVIDER} AS provider_label")
ORACLE["d13_date_text"] = counted(
    EXAM, "exam", "strftime(date_serv, '%Y-%m-%d') AS date_str, strftime(birth, '%Y-%m') AS birth_month, "
    "strftime(d_update, '%Y-%m-%d %H') AS hour")
ORACLE["d13_birth_text"] = counted(EXAM, "exam", "strftime(birth, '%Y-%m-%d') AS birth_str")
_n, _d, _price = "l_partkey % 1000", "l_orderkey % 1000", "l_extendedprice / (l_quantity * 8)"
ORACLE["d14_percent"] = f"""SELECT {_n} AS n, {_d} AS d, {pct(_n, _d)} AS pct,
  coalesce({scaled(f"100.0::DOUBLE * ({_n}) / nullif({_d}, 0)")}, 0.0::DOUBLE) AS pct_scaled,
  {rounded(_price)} AS price, -{rounded(_price, 1)} AS minus, {rounded(f"({_n}) / 8.0::DOUBLE", 0)} AS eighths,
  count(*) AS rows FROM lineitem GROUP BY ALL"""

# ------------------------------------------------------------------------------------------
# Filters

ORACLE["f1_rules"] = f"""WITH {EXAM} SELECT count(*) AS no_rule, 0::BIGINT AS never,
  count(*) FILTER (WHERE {P3} = 0) AS null_sum,
  count(*) FILTER (WHERE need_pfilling = 1) AS null_order,
  count(*) FILTER (WHERE sex IN ('1', '2')) AS is_known,
  count(*) FILTER (WHERE gum = '000000') AS text_equal,
  count(*) FILTER (WHERE gum IS DISTINCT FROM '000000') AS text_not_equal,
  count(*) FILTER (WHERE providertype IS NULL OR providertype = '01') AS not_member,
  count(*) FILTER (WHERE pcaries <> 0) AS number_as_flag,
  count(*) FILTER (WHERE need_pfilling > 0 OR need_dfilling > 0) AS either,
  sum(pcaries + dcaries) AS value, sum(CAST(sex AS DOUBLE)) AS text_value FROM exam"""
ORACLE["f1_rule_language"] = f"""WITH {EXAM} SELECT 0::BIGINT AS never,
  count(*) FILTER (WHERE {P3} = 0) AS null_sum, count(*) FILTER (WHERE need_pfilling = 1) AS null_order,
  count(*) FILTER (WHERE need_pfilling = 1) AS chain, count(*) FILTER (WHERE sex = '1' OR sex = '2') AS is_known,
  count(*) FILTER (WHERE sex IS NULL OR sex = '9') AS not_known, count(*) FILTER (WHERE gum = '000000') AS text_equal,
  count(*) FILTER (WHERE gum IS DISTINCT FROM '000000') AS text_not_equal,
  count(*) FILTER (WHERE providertype IS NULL OR providertype = '01') AS not_member,
  count(*) FILTER (WHERE need_pfilling > 0 OR need_dfilling > 0) AS either,
  count(*) FILTER (WHERE need_pfilling > 0 OR (need_dfilling > 0 AND sex IS DISTINCT FROM '1')) AS signs,
  count(*) FILTER (WHERE pcaries > 0) AS number_unequal, count(*) FILTER (WHERE pteeth BETWEEN 1 AND 3) AS in_numbers,
  count(*) FILTER (WHERE need_dextract = -1) AS minus, count(*) FILTER (WHERE pteeth >= 16) AS half FROM exam"""
ORACLE["f1_typed_rules"] = f"""WITH {EXAM} SELECT
  count(*) FILTER (WHERE providertype <> sex) AS texts_differ, count(*) FILTER (WHERE providertype = sex) AS texts_equal,
  count(*) FILTER (WHERE gum <> hoscode) AS not_texts_equal, 0::BIGINT AS text_is_number, count(sex) AS text_is_no_number,
  0::BIGINT AS number_is_text, count(*) AS number_is_no_text, count(*) FILTER (WHERE sex = '2' AND providertype = '02') AS added_texts,
  count(*) FILTER (WHERE (sex = '2' AND providertype = '02') IS NOT TRUE) AS added_texts_differ,
  count(*) FILTER (WHERE sex = '2') AS mixed_list, count(*) FILTER (WHERE sex IS DISTINCT FROM '2') AS outside_mixed_list,
  0::BIGINT AS no_member, count(*) FILTER (WHERE providertype IN ('02', '06')) AS text_order,
  count(*) FILTER (WHERE pteeth <> dteeth) AS numbers_differ, count(*) FILTER (WHERE date_serv >= birth) AS times FROM exam"""
ORACLE["f2_scope"] = counted(f"{PREPARED},{scoped(SCHOOL)}", "pop", "age, examined", "in_scope")
ORACLE["f3_area"] = counted(PREPARED, "prep", "pvname, ampname, hoscode",
                            "pvname = 'ASIA' AND ampname = 'District 2'")
ORACLE["f4_quality"] = counted(f"{PREPARED},{scoped(PRESCHOOL)}", "pop", "band, q", "in_scope")
_base = "examined AND age BETWEEN 0 AND 12"
ORACLE["f5_denominators"] = f"""WITH {PREPARED}, t AS (SELECT * FROM prep WHERE {_base}),
d AS (SELECT '1' AS table_no, * FROM t WHERE pteeth > 5 UNION ALL SELECT '2', * FROM t UNION ALL SELECT '3', * FROM t
  UNION ALL SELECT '4', * FROM t WHERE sex = '1')
SELECT table_no, 'รวม' AS row_label, count(*) AS base, count(*) FILTER (WHERE pcaries > 0) AS n,
  CAST(NULL AS DOUBLE) AS total, {pct("count(*) FILTER (WHERE pcaries > 0)", "count(*)")} AS value
FROM d GROUP BY table_no
UNION ALL SELECT '5', 'รวม', 0, NULL, 0.0::DOUBLE, NULL"""
ORACLE["f6_pending"] = counted(PREPARED, "prep", "pvname, ampname", "NOT examined")
ORACLE["f7_failed"] = counted(f"{PREPARED},{scoped(PRESCHOOL)}", "pop", "ampname, age", "in_scope AND NOT q")
_reasons = ", ".join(f"CASE WHEN {a} AND NOT coalesce({r}, false) THEN '{n}' END" for n, r, a in PRESCHOOL["checks"])
ORACLE["f8_reasons"] = counted(
    f"{PREPARED},{scoped(PRESCHOOL)}", "pop",
    f"band, coalesce(nullif(concat_ws(' + ', {_reasons}), ''), 'ไม่ผ่านเกณฑ์คุณภาพ') AS reason", "in_scope AND NOT q")

# ------------------------------------------------------------------------------------------
# Tables


def wide_sql(ps: dict, no: str, levels=("all",), with_area: bool = False) -> str:
    kind, metrics = next((k, m) for n, k, m in ps["tables"] if n == no)
    first = "อายุ (ปี)" if ps["rows"] == "age" else "กลุ่มอายุ (ปี)"

    def pick(role: str, j: int, what: str) -> str:
        return f"max({what}) FILTER (WHERE role = '{role}' AND metric_ord = {j})"

    columns = [f'row_label AS "{first}"']
    if kind == "quality":
        columns += [f'{pick("pass", 0, "base")} AS "จำนวนที่ตรวจ"',
                    f'{pick("pass", 0, "n")} AS "จำนวนที่ผ่านเกณฑ์คุณภาพ"', f'{pick("pass", 0, "value")} AS "ร้อยละ"']
        for j, (name, _, _) in enumerate(ps["checks"], 1):
            columns += [f'{pick("check", j, "n")} AS "ไม่ผ่าน: {name}"',
                        f'{pick("check", j, "value")} AS "ร้อยละไม่ผ่าน: {name}"']
    else:
        columns.append('max(base) AS "ฐาน"')
        for j, (name, _) in enumerate(metrics):
            if kind == "mean":
                columns.append(f'{pick("metric", j, "value")} AS "{name}"')
            else:
                columns += [f'{pick("metric", j, "n")} AS "{name} - จำนวน"',
                            f'{pick("metric", j, "value")} AS "{name} - ร้อยละ"']
    area = "level, pvname, ampname, hoscode" if with_area else ""
    return (f"WITH {long_ctes(ps, levels)} SELECT {area + ', ' if area else ''}{', '.join(columns)} FROM long "
            f"WHERE table_no = '{no}' GROUP BY level, pvname, ampname, hoscode, row_ord, row_label")


for _key, _ps, _no in [
    ("a2_quality_age", SCHOOL, "1"), ("a2_quality_bands", PRESCHOOL, "1"), ("a3_count_pct_caries_age", SCHOOL, "2"),
    ("a3_count_pct_gum_age", SCHOOL, "4"), ("a3_count_pct_needs_age", SCHOOL, "6"),
    ("a3_count_pct_caries_bands", PRESCHOOL, "2"), ("a3_count_pct_needs_bands", PRESCHOOL, "7"),
    ("a4_mean_teeth_age", SCHOOL, "3"), ("a4_mean_sextants_age", SCHOOL, "5"), ("a4_mean_teeth_bands", PRESCHOOL, "3"),
]:
    ORACLE[_key] = wide_sql(_ps, _no)

_scope = "examined AND age BETWEEN 3 AND 7"
_q = "(pteeth > 3 AND (band <> '3-5' OR dteeth > 9))"
ORACLE["a1_groups_and_total"] = f"""WITH {PREPARED}, t AS (SELECT *, {_q} AS q FROM prep WHERE {_scope}),
r AS (
  SELECT '1' AS table_no, CASE grouping(age) WHEN 1 THEN 'รวม' ELSE CAST(age AS VARCHAR) END AS row_label,
    count(*) FILTER (WHERE q) AS base, count(*) FILTER (WHERE q AND pcaries > 0) AS n, NULL AS total
  FROM t GROUP BY GROUPING SETS ((age), ())
  UNION ALL
  SELECT '2', CASE grouping(band) WHEN 1 THEN 'รวม' ELSE band END, count(*) FILTER (WHERE q), NULL,
    coalesce(sum(pteeth) FILTER (WHERE q), 0)
  FROM t GROUP BY GROUPING SETS ((band), ()) HAVING grouping(band) = 1 OR band IS NOT NULL
  UNION ALL SELECT '2', '0-2', 0, NULL, 0
  UNION ALL SELECT '3', 'รวม', count(*), NULL, sum(dmft_p) FROM t)
SELECT table_no, row_label, 'm' AS metric, base, n, CAST(total AS DOUBLE) AS total,
  CASE table_no WHEN '1' THEN {pct("n", "base", 1)} WHEN '2' THEN {mean("total", "base", 3)}
    ELSE {mean("total", "base", 2)} END AS value FROM r"""

_shown = "table_no, row_label, metric, base, n, total, value"
ORACLE["a5_report_school_age"] = f"WITH {long_ctes(SCHOOL)} SELECT {_shown} FROM long"
ORACLE["a5_report_preschool"] = f"WITH {long_ctes(PRESCHOOL)} SELECT {_shown} FROM long"
ORACLE["a5_report_all_areas_school_age"] = (
    f"WITH {long_ctes(SCHOOL, LEVELS)} SELECT level, pvname, ampname, hoscode, {_shown} FROM long")
ORACLE["a5_report_all_areas_preschool"] = (
    f"WITH {long_ctes(PRESCHOOL, LEVELS)} SELECT level, pvname, ampname, hoscode, {_shown} FROM long")


def headline_ctes(ps: dict, levels) -> str:
    parts = []
    for level in levels:
        keys = LEVELS[level]
        shown = ", ".join(k if k in keys else f"CAST(NULL AS VARCHAR) AS {k}" for k in AREA)
        group = f"GROUP BY {', '.join(keys)}" if keys else ""
        parts.append(f"""SELECT '{level}' AS level, {shown}, count(*) FILTER (WHERE in_scope) AS examined,
  count(*) FILTER (WHERE in_scope AND q) AS qualified, count(DISTINCT hoscode_) FILTER (WHERE in_scope) AS hospitals,
  count(DISTINCT ampname_) FILTER (WHERE in_scope) AS districts,
  coalesce(strftime(min(date_serv) FILTER (WHERE in_scope), '%Y-%m-%d'), '-') AS date_min,
  coalesce(strftime(max(date_serv) FILTER (WHERE in_scope), '%Y-%m-%d'), '-') AS date_max,
  count(*) AS target, count(*) FILTER (WHERE NOT examined) AS pending
FROM (SELECT *, hoscode AS hoscode_, ampname AS ampname_ FROM pop) {group}""")
    return f"""{PREPARED}, {scoped(ps)}, h0 AS ({" UNION ALL ".join(parts)}),
head AS (SELECT *, coalesce({scaled("100.0::DOUBLE * qualified / nullif(examined, 0)")}, 0.0::DOUBLE) AS qualified_pct,
  {pct("examined", "target")} AS examined_pct, target - examined - pending AS out_of_range FROM h0)"""


_headline = "examined, qualified, qualified_pct, hospitals, districts, date_min, date_max"
ORACLE["a6_headline"] = f"WITH {headline_ctes(SCHOOL, ['all'])} SELECT {_headline} FROM head"
ORACLE["a6_headline_areas"] = (f"WITH {headline_ctes(PRESCHOOL, ['province', 'district'])} "
                               f"SELECT level, pvname, ampname, {_headline} FROM head")
ORACLE["a7_reconcile"] = (f"WITH {headline_ctes(SCHOOL, ['all', 'province'])} SELECT level, pvname, target, examined, "
                          f"examined_pct, pending, out_of_range FROM head")


def breakdown_ctes(ps: dict, by: str) -> str:
    key = "ampname" if by == "district" else "hoscode"
    code = "min(ampcode)" if by == "district" else key
    name = key if by == "district" else "coalesce(min(hosname), hoscode)"
    return f"""{PREPARED}, {scoped(ps)}, b0 AS (
  SELECT {key} AS k, {code} AS cd, {name} AS nm, count(*) AS target, count(*) FILTER (WHERE in_scope) AS examined,
    count(*) FILTER (WHERE NOT examined) AS pending, count(*) FILTER (WHERE in_scope AND q) AS qualified,
    count(*) FILTER (WHERE in_scope AND q AND ({ps['cf']})) AS caries_free,
    coalesce(sum({ps['dmft']}) FILTER (WHERE in_scope AND q), 0) AS d
  FROM pop GROUP BY {key}),
bd AS (SELECT coalesce(k, 'ไม่ระบุ') AS key, coalesce(cd, '') AS code, coalesce(nm, k, 'ไม่ระบุ') AS name,
  target, examined, pending, examined - qualified AS failed, {pct("examined", "target")} AS examined_pct, qualified,
  {pct("qualified", "examined")} AS qualified_pct, caries_free, {pct("caries_free", "qualified")} AS caries_free_pct,
  {mean("d", "qualified")} AS dmft FROM b0)"""


def labelled(cf: str, dmft: str, by: str) -> str:
    unit = "อำเภอ" if by == "district" else "หน่วยบริการ"
    return (f'SELECT code AS "รหัส{unit}", name AS "{unit}", target AS "เป้าหมาย (คน)", examined AS "ตรวจ (คน)", '
            f'pending AS "ยังไม่ได้ตรวจ (คน)", examined_pct AS "%ได้รับการตรวจฟัน", '
            f'qualified AS "ผ่านเกณฑ์คุณภาพ (คน)", qualified_pct AS "%ผ่านเกณฑ์คุณภาพ", '
            f'caries_free_pct AS "%{cf}", dmft AS "{dmft}" FROM bd')


ORACLE["a8_district_school_age"] = f"WITH {breakdown_ctes(SCHOOL, 'district')} SELECT * FROM bd"
ORACLE["a8_district_preschool"] = f"WITH {breakdown_ctes(PRESCHOOL, 'district')} SELECT * FROM bd"
ORACLE["a9_facility_school_age"] = f"WITH {breakdown_ctes(SCHOOL, 'unit')} SELECT * FROM bd"
ORACLE["a9_facility_preschool"] = f"WITH {breakdown_ctes(PRESCHOOL, 'unit')} SELECT * FROM bd"
_gum = {"min": 6, "max": 12, "quality": "coalesce(pteeth > 0, false)", "cf": "gum_status = '0'",
        "dmft": "gum_sx_1 + gum_sx_2"}
ORACLE["a10_breakdown_choice"] = (f"WITH {breakdown_ctes(_gum, 'district')} "
                                  f"{labelled('healthy gum', 'sextants', 'district')}")
ORACLE["o1_breakdown_order"] = (
    f"WITH {breakdown_ctes(SCHOOL, 'unit')} SELECT code, name, target, "
    f"row_number() OVER (ORDER BY nullif(code, '') NULLS LAST, name, key) - 1 AS place FROM bd")
ORACLE["o2_group_order"] = (f'WITH {long_ctes(SCHOOL)} SELECT row_label AS "อายุ (ปี)", base AS "ฐาน", '
                            f"row_number() OVER (ORDER BY is_total, row_ord) - 1 AS place FROM long "
                            f"WHERE table_no = '2' AND metric_ord = 0")
ORACLE["a11_area_tree"] = f"""WITH {ATTACHED}
SELECT DISTINCT 'province' AS level, pvname, NULL AS ampname, NULL AS code, NULL AS name FROM att
UNION ALL SELECT DISTINCT 'district', pvname, ampname, NULL, NULL FROM att
UNION ALL SELECT 'facility', pvname, ampname, hoscode, min(coalesce(hosname, hoscode)) FROM att
WHERE hoscode IS NOT NULL GROUP BY pvname, ampname, hoscode"""
ORACLE["a12_distinct"] = f"WITH {ATTACHED} SELECT DISTINCT pvname, ampname, hostype FROM att"

# ------------------------------------------------------------------------------------------
# Findings

FOUND_KEYS = "level, pvname, ampname, table_no"
HIGH = "(metric LIKE '%ปราศจาก%' OR metric LIKE '%ฟันดี%' OR metric LIKE '%ปกติ%' OR metric LIKE '%ฟันที่มีในปาก%')"


def story_ctes(ps: dict) -> str:
    """Long report with the primary metric, directions and row names; ``ser`` its group series."""
    name = "row_label || ' ปี'" if ps["rows"] == "age" else "'กลุ่ม ' || row_label || ' ปี'"
    partition = f"PARTITION BY {FOUND_KEYS}"
    return f"""{long_ctes(ps, ("all", "district"))},
st AS (SELECT *, {name} AS nm, {HIGH} AS high, kind = 'count_pct' AS is_pct,
    CASE WHEN kind = 'count_pct' THEN '%' ELSE '' END AS u, CASE WHEN kind = 'count_pct' THEN 'จุด' ELSE 'ซี่' END AS w,
    min(CASE WHEN metric LIKE '%ปราศจาก%' OR metric LIKE '%ผุถอนอุด%' THEN metric_ord ELSE 1000 + metric_ord END)
      OVER ({partition}) % 1000 AS chosen,
    max(CASE WHEN is_total THEN value END) OVER ({partition}, metric_ord) AS total_value
  FROM long),
prim AS (SELECT *, value - total_value AS gap FROM st WHERE metric_ord = chosen),
ser AS (SELECT *, row_number() OVER ({partition} ORDER BY row_ord) AS i,
    count(*) OVER ({partition}) AS len,
    row_number() OVER ({partition} ORDER BY value, row_ord) AS low_rank,
    row_number() OVER ({partition} ORDER BY value DESC, row_ord) AS high_rank,
    lead(value) OVER ({partition} ORDER BY row_ord) - value AS step,
    lead(nm) OVER ({partition} ORDER BY row_ord) AS next_nm
  FROM prim WHERE NOT is_total AND value IS NOT NULL)"""


def same(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in ("level", "pvname", "ampname", "table_no"))


TONE = "CASE WHEN {v} >= 90 THEN 'good' WHEN {v} >= 75 THEN 'warn' ELSE 'bad' END"
NOT_QUALITY = "kind <> 'quality'"
BODIES = {
    "i1_quality_headline": f"""SELECT {FOUND_KEYS}, '' AS item, {TONE.format(v='coalesce(value, 0)')} AS tone,
      'ภาพรวมผ่านเกณฑ์คุณภาพ ' || {text('value')} || '% (' || {text('n', 0)} || ' จาก ' || {text('base', 0)} ||
      ' คน) — ข้อมูลที่ตกเกณฑ์ ' || {text('base - n', 0)} || ' คนจะไม่ถูกนับในตารางถัดไป' AS text
      FROM prim WHERE kind = 'quality' AND is_total""",
    "i2_quality_range": f"""SELECT a.level, a.pvname, a.ampname, a.table_no, '' AS item, 'warn' AS tone,
      a.nm || ' ผ่านเกณฑ์ต่ำสุด ' || {text('a.value')} || '% ขณะที่ ' || b.nm || ' สูงสุด ' || {text('b.value')} ||
      '% — ต่างกัน ' || {text('b.value - a.value', 1)} || ' จุด' AS text
      FROM ser a JOIN ser b ON {same('a', 'b')} AND a.low_rank = 1 AND b.high_rank = 1
      WHERE a.kind = 'quality' AND b.value - a.value >= 2.0""",
    "i3_top_cause": f"""SELECT c.level, c.pvname, c.ampname, c.table_no, '' AS item, 'bad' AS tone,
      'สาเหตุที่ตกเกณฑ์มากที่สุดคือ “' || c.metric || '” ' || {text('c.n', 0)} || ' รายการ' ||
      CASE WHEN t.base > t.n THEN ' (≈' || {text('100.0::DOUBLE * c.n / nullif(t.base - t.n, 0)', 0)} ||
        '% ของที่ตกเกณฑ์)' ELSE '' END || ' — ใช้ปุ่ม “ไม่ผ่านเกณฑ์” ในตารางภาพรวมเพื่อดูรายชื่อ' AS text
      FROM (SELECT *, row_number() OVER (PARTITION BY {FOUND_KEYS} ORDER BY n DESC, metric_ord) AS rk
            FROM st WHERE role = 'check' AND is_total AND n > 0) c
      JOIN prim t ON {same('c', 't')} AND t.is_total AND t.kind = 'quality' WHERE rk = 1""",
    "i4_quality_rows": f"""SELECT {FOUND_KEYS}, row_label AS item, {TONE.format(v='value')} AS tone,
      'ผ่านเกณฑ์ ' || {text('value')} || '%' ||
      CASE WHEN abs(gap) >= 2.0 THEN ' (' || CASE WHEN gap > 0 THEN 'สูงกว่า' ELSE 'ต่ำกว่า' END || 'ภาพรวม ' ||
        {text('abs(gap)', 1)} || ' จุด)' ELSE '' END ||
      CASE WHEN base > n THEN ' · ตกเกณฑ์ ' || {text('base - n', 0)} || ' คน' ELSE '' END AS text
      FROM ser WHERE kind = 'quality'""".replace("FROM ser", "FROM (SELECT * FROM ser)"),
    "i6_overall": f"""SELECT {FOUND_KEYS}, '' AS item, 'info' AS tone,
      'ภาพรวมทุกอายุ: ' || metric || ' = ' || {text('value')} || u AS text FROM prim p
      WHERE {NOT_QUALITY} AND is_total AND value IS NOT NULL
        AND EXISTS (SELECT 1 FROM ser s WHERE {same('s', 'p')})""",
    "i7_trend": f"""SELECT * EXCLUDE (d) FROM (SELECT a.level, a.pvname, a.ampname, a.table_no, '' AS item,
      b.value - a.value AS d,
      CASE WHEN (a.high AND b.value < a.value) OR (NOT a.high AND b.value > a.value) THEN 'bad' ELSE 'good' END AS tone,
      a.metric || ' เปลี่ยนจาก ' || {text('a.value')} || a.u || ' ที่ ' || a.nm || ' เป็น ' || {text('b.value')} || a.u ||
      ' ที่ ' || b.nm || ' (' || CASE WHEN b.value < a.value THEN 'ลดลง' ELSE 'เพิ่มขึ้น' END || ' ' ||
      {text('abs(b.value - a.value)', 1)} || ' ' || a.w || ') — ' ||
      CASE WHEN (a.high AND b.value < a.value) OR (NOT a.high AND b.value > a.value)
        THEN 'ยิ่งอายุมากยิ่งแย่ลง' ELSE 'ยิ่งอายุมากยิ่งดีขึ้น' END AS text
      FROM ser a JOIN ser b ON {same('a', 'b')} AND a.i = 1 AND b.i = b.len WHERE a.{NOT_QUALITY})
      WHERE abs(d) >= 2.0""",
    "i8_focus": f"""SELECT a.level, a.pvname, a.ampname, a.table_no, '' AS item, 'warn' AS tone,
      'ควรเน้น ' || a.nm || ' — ' || a.metric || ' ' || {text('a.value')} || a.u || ' (' ||
      CASE WHEN a.high THEN 'ต่ำสุด' ELSE 'สูงสุด' END || ') เทียบกับ ' || b.nm || ' ที่ ' || {text('b.value')} || a.u AS text
      FROM ser a JOIN ser b ON {same('a', 'b')} AND (CASE WHEN a.high THEN a.low_rank ELSE a.high_rank END) = 1
        AND (CASE WHEN b.high THEN b.high_rank ELSE b.low_rank END) = 1
      WHERE a.{NOT_QUALITY} AND a.row_ord <> b.row_ord""",
    "i9_fastest_step": f"""SELECT {FOUND_KEYS}, '' AS item, 'warn' AS tone,
      'เปลี่ยนแปลงเร็วที่สุดช่วง ' || nm || ' → ' || next_nm || ' (' || {text('abs(step)', 1)} || ' ' || w ||
      ') — เป็นช่วงที่ควรแทรกแซงก่อนสาย' AS text
      FROM (SELECT *, row_number() OVER (PARTITION BY {FOUND_KEYS}
              ORDER BY CASE WHEN high THEN step ELSE -step END, row_ord) AS rk
            FROM ser WHERE step IS NOT NULL AND len >= 3)
      WHERE {NOT_QUALITY} AND rk = 1 AND abs(step) >= 2.0 AND (CASE WHEN high THEN step < 0 ELSE step > 0 END)""",
    "i10_top_problem": f"""SELECT {FOUND_KEYS}, '' AS item, 'info' AS tone,
      'รายการที่พบมากที่สุดคือ ' || metric || ' = ' || {text('value')} || u AS text
      FROM (SELECT *, row_number() OVER (PARTITION BY {FOUND_KEYS} ORDER BY value DESC, metric_ord) AS rk
            FROM st WHERE {NOT_QUALITY} AND is_total AND NOT high AND value > 0) p
      WHERE rk = 1 AND metric_ord <> chosen AND EXISTS (SELECT 1 FROM ser s WHERE {same('s', 'p')})""",
    "i11_small_base": f"""SELECT {FOUND_KEYS}, '' AS item, 'warn' AS tone,
      'ฐานข้อมูลน้อย ควรระวังการตีความ: ' || string_agg(nm || ' (' || {text('base', 0)} || ' คน)', ', ' ORDER BY row_ord) AS text
      FROM prim WHERE {NOT_QUALITY} AND NOT is_total AND base BETWEEN 1 AND 29 GROUP BY {FOUND_KEYS}""",
    "i12_metric_rows": f"""SELECT {FOUND_KEYS}, item, tone, text FROM (
      SELECT s.level, s.pvname, s.ampname, s.table_no, s.row_label AS item,
      CASE WHEN s.base < 30 THEN 'warn' WHEN abs(s.gap) >= 2.0 THEN
        CASE WHEN s.high = (s.gap > 0) THEN 'good' ELSE 'bad' END ELSE 'info' END AS tone,
      s.metric || ' ' || {text('s.value')} || s.u ||
      CASE WHEN abs(s.gap) >= 2.0 THEN ' (' || CASE WHEN s.high = (s.gap > 0) THEN 'ดีกว่า' ELSE 'แย่กว่า' END ||
        'ภาพรวม ' || {text('abs(s.gap)', 1)} || ' ' || s.w || ')' ELSE '' END ||
      CASE WHEN d.metric IS NOT NULL THEN ' · เด่น: ' || d.metric || ' ' || {text('d.value')} || s.u ||
        ' (สูงกว่าภาพรวม ' || {text('d.gap', 1)} || ' ' || s.w || ')' ELSE '' END ||
      CASE WHEN s.base < 30 THEN ' · ฐานเพียง ' || {text('s.base', 0)} || ' คน' ELSE '' END AS text
      FROM ser s LEFT JOIN (
        SELECT *, value - total_value AS gap, row_number() OVER (PARTITION BY {FOUND_KEYS}, row_ord
          ORDER BY value - total_value DESC, metric_ord) AS rk
        FROM st WHERE {NOT_QUALITY} AND NOT high AND metric_ord <> chosen AND value - total_value >= 2.0) d
      ON {same('s', 'd')} AND s.row_ord = d.row_ord AND d.rk = 1 WHERE s.{NOT_QUALITY})""",
}


def both(body: str) -> str:
    parts = [f"SELECT '{ps['id']}' AS profile, * FROM (WITH {story_ctes(ps)} {body})" for ps in (SCHOOL, PRESCHOOL)]
    return " UNION ALL ".join(parts)


for _key, _body in BODIES.items():
    ORACLE[_key] = both(_body)
ORACLE["i5_primary_metric"] = f"""WITH {story_ctes(SCHOOL)}
SELECT level, pvname, ampname, table_no, metric, value FROM prim WHERE is_total AND {NOT_QUALITY}"""

TITLES = {
    "1": "ข้อมูลคุณภาพของข้อมูลการตรวจแยกรายกลุ่มอายุ",
    "2": "ร้อยละของผู้ปราศจากโรคฟันผุและมีประสบการณ์ฟันผุ (ฟันน้ำนม)",
    "3": "ค่าเฉลี่ยฟันผุถอนอุดในกลุ่มอายุต่างๆ (ซี่ต่อคน, ฟันน้ำนม)",
    "7": "ความจำเป็นในการรักษา",
}
_head = "CASE table_no " + " ".join(f"WHEN '{n}' THEN 'ตารางที่ {n} {t}'" for n, t in TITLES.items()) + " END"
_every = " UNION ALL ".join(f"(WITH {story_ctes(PRESCHOOL)} SELECT level, table_no, item, tone, text FROM ({b}))"
                            for b in BODIES.values())
ORACLE["i13_findings_table"] = f"""SELECT {_head} AS "ตาราง",
  CASE WHEN item = '' THEN 'ภาพรวม' ELSE 'กลุ่มอายุ (ปี)' END AS "ระดับ", item AS "รายการ",
  CASE tone WHEN 'good' THEN 'ดี' WHEN 'warn' THEN 'เฝ้าระวัง' WHEN 'bad' THEN 'ต้องแก้ไข' ELSE 'ข้อมูล' END AS "สถานะ",
  text AS "ข้อสรุป" FROM ({_every}) WHERE level = 'all'"""

ORACLE["i13_no_findings"] = f"""WITH {EXAM} SELECT '-' AS "ตาราง", '-' AS "ระดับ", '-' AS "รายการ", '-' AS "สถานะ",
  'ไม่มีข้อสรุป' AS "ข้อสรุป" FROM (SELECT count(*) FILTER (WHERE pteeth > 1000) AS n FROM exam) WHERE n = 0"""

# ------------------------------------------------------------------------------------------
# Person lists

PENDING = f"""hoscode AS "รหัสหน่วยบริการ", hosname AS "หน่วยบริการ", ampname AS "อำเภอ", pid AS "PID",
  cid AS "เลขบัตรประชาชน", name AS "ชื่อ", lname AS "นามสกุล", {SEX} AS "เพศ",
  strftime(birth, '%Y-%m-%d') AS "วันเกิด", {TODAY} AS "อายุปัจจุบัน (ปี)", addr AS "บ้านเลขที่",
  check_typearea AS typearea, tumbonname AS "ตำบล" """


def failed_columns(ps: dict) -> str:
    reasons = ", ".join(f"CASE WHEN {a} AND NOT coalesce({r}, false) THEN '{n}' END" for n, r, a in ps["checks"])
    return f"""hoscode AS "รหัสหน่วยบริการ", hosname AS "หน่วยบริการ", ampname AS "อำเภอ",
  coalesce(nullif(concat_ws(' + ', {reasons}), ''), 'ไม่ผ่านเกณฑ์คุณภาพ') AS "สาเหตุที่ไม่ผ่านเกณฑ์",
  pid AS "PID", cid AS "เลขบัตรประชาชน", name AS "ชื่อ", lname AS "นามสกุล", {SEX} AS "เพศ",
  strftime(birth, '%Y-%m-%d') AS "วันเกิด", age AS "อายุขณะตรวจ (ปี)", strftime(date_serv, '%Y-%m-%d') AS "วันที่ตรวจ",
  {PROVIDER} AS "ผู้ตรวจ", pteeth AS "ฟันแท้ที่มี (ซี่)", dteeth AS "ฟันน้ำนมที่มี (ซี่)", addr AS "บ้านเลขที่",
  tumbonname AS "ตำบล" """


RAW = ", ".join(
    [c for c in TEXTS if c != "pid"] + ["pid AS pid_raw"] + NUMBERS
    + ["strftime(birth, '%Y-%m-%d') AS birth", "strftime(date_serv, '%Y-%m-%d') AS date_serv",
       "strftime(d_update, '%Y-%m-%d %H:%M:%S') AS d_update"]
    + ["age", "age_month", "band", "examined", "gum_status", "gum_label", "gum_sx_0", "gum_sx_1", "gum_sx_2",
       "gum_sx_3", "gum_sx_9", "dmft_p", "dmft_d"])
ORACLE["p1_pending_list"] = f"WITH {PREPARED} SELECT {PENDING} FROM prep WHERE NOT examined"
ORACLE["p2_failed_list"] = (f"WITH {PREPARED},{scoped(SCHOOL)} SELECT {failed_columns(SCHOOL)} FROM pop "
                            f"WHERE in_scope AND NOT q")
ORACLE["p3_failed_list_raw"] = (f"WITH {PREPARED},{scoped(PRESCHOOL)} SELECT {failed_columns(PRESCHOOL)}, {RAW}, "
                                f"'lineitem.parquet' AS \"ไฟล์ต้นทาง\" FROM pop WHERE in_scope AND NOT q")
ORACLE["p4_sorted_page"] = (f"WITH {PREPARED},{scoped(SCHOOL)} SELECT {failed_columns(SCHOOL)} FROM pop "
                            f"WHERE in_scope AND NOT q ORDER BY pop.hoscode NULLS LAST, pop.age, pop.cid LIMIT 500")
ORACLE["p5_pending_page"] = (f"WITH {PREPARED} SELECT {PENDING} FROM prep WHERE NOT examined AND pvname = 'ASIA' "
                             f"ORDER BY prep.hoscode NULLS LAST, prep.birth NULLS LAST, prep.cid LIMIT 100")

ORACLE["p5_pending_pages"] = (f"WITH {PREPARED} SELECT {PENDING}, CAST((row_number() OVER w + 39) // 40 AS INTEGER) AS page, count(*) OVER () AS total "
                              f"FROM prep WHERE NOT examined AND pvname = 'ASIA' "
                              f"WINDOW w AS (ORDER BY prep.hoscode NULLS LAST, prep.birth NULLS LAST, prep.cid) QUALIFY row_number() OVER w <= 120")
ORACLE["p5_failed_pages"] = (f"WITH {PREPARED},{scoped(SCHOOL)} SELECT {failed_columns(SCHOOL)}, "
                             f"CAST((row_number() OVER w + 149) // 150 AS INTEGER) AS page, count(*) OVER () AS total FROM pop "
                             f"WHERE in_scope AND NOT q WINDOW w AS (ORDER BY pop.hoscode NULLS LAST, pop.age, pop.cid) "
                             f"QUALIFY row_number() OVER w <= 300")
ORACLE["p5_total"] = (f"WITH {PREPARED} SELECT least(count(*), 100)::BIGINT AS shown, count(*) AS total FROM prep "
                      f"WHERE NOT examined AND pvname = 'ASIA'")

# ------------------------------------------------------------------------------------------
# Sinks

ORACLE["k1_flat_table_areas"] = wide_sql(PRESCHOOL, "3", ("all", "district"), True)
ORACLE["k2_breakdown_table"] = (f"WITH {breakdown_ctes(PRESCHOOL, 'unit')} "
                                f"{labelled('ปราศจากฟันผุ (ฟันน้ำนม)', 'dmft เฉลี่ย', 'unit')}")
_rows = [("กลุ่มอายุ", f"'{SCHOOL['label']}'"),
         ("ขอบเขต", "coalesce(nullif(concat_ws(' › ', pvname, ampname), ''), 'ทุกพื้นที่ในข้อมูล')"),
         ("เด็กในเขตรับผิดชอบ (คน)", "target"), ("ได้รับการตรวจฟัน (คน)", "examined"),
         ("ร้อยละได้รับการตรวจฟัน", "examined_pct"), ("ผ่านเกณฑ์คุณภาพ (คน)", "qualified"),
         ("ร้อยละผ่านเกณฑ์คุณภาพ", "qualified_pct"), ("จำนวนหน่วยบริการ", "hospitals"), ("จำนวนอำเภอ", "districts"),
         ("วันที่ตรวจแรกสุด", "date_min"), ("วันที่ตรวจล่าสุด", "date_max"), ("วันที่ออกรายงาน", f"'{AS_OF}'")]
ORACLE["k3_header_table"] = f"WITH {headline_ctes(SCHOOL, ['all', 'district'])} " + " UNION ALL ".join(
    f"SELECT level, pvname, ampname, {i} AS ord, '{title}' AS \"รายการ\", CAST({value} AS VARCHAR) AS \"ค่า\" FROM head"
    for i, (title, value) in enumerate(_rows))
_k4 = wide_sql(SCHOOL, "2", ("all", "province"), True)
ORACLE["k4_csv"] = f"SELECT CAST(COLUMNS(* EXCLUDE (ampname, hoscode)) AS VARCHAR) FROM ({_k4})"
ORACLE["k5_bundle"] = wide_sql(SCHOOL, "5")
ORACLE["k6_snapshot"] = f"""WITH {TEXT},{FACILITY},
att AS (
  SELECT e.* REPLACE (CASE WHEN po % 3 <> 1 THEN e.gum END AS gum, coalesce(e.hosname, f.hosname) AS hosname),
    coalesce(f.ampname, 'ไม่ระบุ') AS ampname, coalesce(f.pvname, 'ไม่ระบุ') AS pvname
  FROM clean e LEFT JOIN fac f ON e.hoscode = f.hoscode),
{derived_from('att')} SELECT pvname, band, gum_status, examined, count(*) AS n FROM prep GROUP BY ALL"""
ORACLE["k6_changed_files"] = ORACLE["k6_snapshot"].replace("CASE WHEN po % 3 <> 1 THEN e.gum END AS gum", "e.gum AS gum")
ORACLE["a1_maintained_cells"] = ORACLE["k6_changed_files"].replace(
    "SELECT pvname, band, gum_status, examined, count(*) AS n FROM prep",
    "SELECT pvname, ampname, count(*) AS target, count(*) FILTER (WHERE NOT examined) AS pending, count(DISTINCT hoscode) AS units, "
    "count(*) FILTER (WHERE examined AND age BETWEEN 0 AND 5) AS in_scope, "
    "strftime(max(date_serv) FILTER (WHERE examined AND age BETWEEN 0 AND 5), '%Y-%m-%d') AS last FROM prep")
ORACLE["k5_bundle_header"] = f"WITH {headline_ctes(SCHOOL, ['all'])} " + " UNION ALL ".join(
    f"SELECT {i} AS ord, '{title}' AS \"รายการ\", CAST({value} AS VARCHAR) AS \"ค่า\" FROM head"
    for i, (title, value) in enumerate(_rows))
ORACLE["k5_bundle_districts"] = (f"WITH {breakdown_ctes(PRESCHOOL, 'district')} "
                                 f"{labelled('ปราศจากฟันผุ (ฟันน้ำนม)', 'dmft เฉลี่ย', 'district')}")
ORACLE["k5_bundle_findings"] = ORACLE["i13_findings_table"]
_NOTES = [
    ("2", 0, "ตารางที่ 2 ร้อยละของผู้ปราศจากโรคฟันผุและมีประสบการณ์ฟันผุ (ฟันน้ำนม)"),
    ("2", 1, "ปราศจากฟันผุ = dcaries + dfilling + dextract = 0"),
    ("2", 2, "ฟันดีไม่มีผุ = dcaries + dextract = 0"),
    ("2", 3, "ฟันผุไม่ได้รักษา = dcaries > 0 | ฟันถอน = dextract > 0 | ฟันอุด = dfilling > 0"),
    ("2", 4, "ฟันผุถอนอุด = dcaries + dfilling + dextract > 0"),
    ("3", 0, "ตารางที่ 3 ค่าเฉลี่ยฟันผุถอนอุดในกลุ่มอายุต่างๆ (ซี่ต่อคน, ฟันน้ำนม)"),
    ("3", 1, "ฟันที่มีในปาก = dteeth"),
    ("3", 2, "ค่าเฉลี่ยแต่ละช่อง = ผลรวมของช่องนั้น ÷ จำนวนคนที่ตรวจผ่านเกณฑ์คุณภาพ"),
]
_notes = ", ".join(str(note) for note in _NOTES)
ORACLE["k5_bundle_notes"] = f"""WITH {long_ctes(PRESCHOOL)}
SELECT n.table_no, n.ord, n.note, b.base FROM (VALUES {_notes}) AS n(table_no, ord, note)
JOIN (SELECT table_no, max(base) AS base FROM long WHERE is_total GROUP BY table_no) b ON b.table_no = n.table_no"""
_district = "pvname = 'ASIA' AND ampname = 'District 2'"
ORACLE["k5_bundle_area"] = ORACLE["k2_breakdown_table"].replace("FROM pop GROUP BY", f"FROM pop WHERE {_district} GROUP BY")
ORACLE["k5_bundle_area_table"] = wide_sql(PRESCHOOL, "2").replace("FROM pop)", f"FROM pop WHERE {_district})")
ORACLE["k6_rule_change"] = ORACLE["k6_snapshot"].replace(
    "SELECT pvname, band, gum_status, examined, count(*) AS n FROM prep",
    "SELECT CASE WHEN pvname = 'ไม่ระบุ' THEN pvname ELSE 'new ' || pvname END AS pvname, "
    "CASE WHEN age BETWEEN 0 AND 3 THEN '0-3' WHEN age BETWEEN 4 AND 5 THEN '4-5' END AS band, count(*) AS n FROM prep")
