"""Every label, word list, threshold and sentence a report shows."""

# Report rows and columns.
TOTAL_LABEL = "รวม"
UNKNOWN_AREA = "ไม่ระบุ"
BASE_LABEL = "ฐาน"
COUNT_LABEL = "จำนวน"
PERCENT_LABEL = "ร้อยละ"
EXAMINED_LABEL = "จำนวนที่ตรวจ"
PASSED_LABEL = "จำนวนที่ผ่านเกณฑ์คุณภาพ"
FAILED_CHECK = "ไม่ผ่าน: "
FAILED_CHECK_PERCENT = "ร้อยละไม่ผ่าน: "
ROW_LABELS = {"age": "อายุ (ปี)", "band": "กลุ่มอายุ (ปี)", "none": "รายการ"}

# Follow-up lists.
SEX_LABELS = {"1": "ชาย", "2": "หญิง"}
PROVIDER_LABELS = {"02": "ทันตแพทย์", "06": "ทันตาภิบาล"}
OTHER_PROVIDER = "อื่น ๆ (%s)"
UNKNOWN_PROVIDER = "ไม่ระบุ"
NO_REASON = "ไม่ผ่านเกณฑ์คุณภาพ"
REASON_SEPARATOR = " + "
SOURCE_FILE_LABEL = "ไฟล์ต้นทาง"
PENDING_COLUMNS = [
    ("hoscode", "รหัสหน่วยบริการ"),
    ("hosname", "หน่วยบริการ"),
    ("ampname", "อำเภอ"),
    ("agegroup", "กลุ่มอายุ"),
    ("pid", "PID"),
    ("cid", "เลขบัตรประชาชน"),
    ("name", "ชื่อ"),
    ("lname", "นามสกุล"),
    ("sex_label", "เพศ"),
    ("birth_str", "วันเกิด"),
    ("age_today", "อายุปัจจุบัน (ปี)"),
    ("addr", "บ้านเลขที่"),
    ("check_typearea", "typearea"),
    ("tumbonname", "ตำบล"),
]
FAILED_COLUMNS = [
    ("hoscode", "รหัสหน่วยบริการ"),
    ("hosname", "หน่วยบริการ"),
    ("ampname", "อำเภอ"),
    ("fail_reason", "สาเหตุที่ไม่ผ่านเกณฑ์"),
    ("pid", "PID"),
    ("cid", "เลขบัตรประชาชน"),
    ("name", "ชื่อ"),
    ("lname", "นามสกุล"),
    ("sex_label", "เพศ"),
    ("birth_str", "วันเกิด"),
    ("age", "อายุขณะตรวจ (ปี)"),
    ("date_str", "วันที่ตรวจ"),
    ("provider_label", "ผู้ตรวจ"),
    ("pteeth", "ฟันแท้ที่มี (ซี่)"),
    ("dteeth", "ฟันน้ำนมที่มี (ซี่)"),
    ("addr", "บ้านเลขที่"),
    ("tumbonname", "ตำบล"),
]

# Columns of a record that do not come from the source files.
AREA_COLUMNS = ["pvcode", "pvname", "ampcode", "ampname", "tumcode", "tumbonname",
                "hostype", "hosname_ref"]
COMPUTED_COLUMNS = ["age", "age_month", "band", "examined", "gum_status", "gum_label",
                    "gum_sx_0", "gum_sx_1", "gum_sx_2", "gum_sx_3", "gum_sx_9",
                    "dmft_p", "dmft_d"]
LIST_COLUMNS = ["age_today", "birth_str", "date_str", "sex_label",
                "provider_label", "fail_reason"]

# Area breakdown.
DISTRICT_WORD = "อำเภอ"
UNIT_WORD = "หน่วยบริการ"
CODE_WORD = "รหัส"
BREAKDOWN_COLUMNS = [
    ("target", "เป้าหมาย (คน)"),
    ("examined", "ตรวจ (คน)"),
    ("pending", "ยังไม่ได้ตรวจ (คน)"),
    ("examined_pct", "%ได้รับการตรวจฟัน"),
    ("qualified", "ผ่านเกณฑ์คุณภาพ (คน)"),
    ("qualified_pct", "%ผ่านเกณฑ์คุณภาพ"),
]

# Report header.
HEADER_ITEM = "รายการ"
HEADER_VALUE = "ค่า"
HEADER_ALL_AREAS = "ทุกพื้นที่ในข้อมูล"
HEADER_AREA_SEPARATOR = " › "
HEADER_ROWS = [
    ("label", "กลุ่มอายุ"),
    ("area", "ขอบเขต"),
    ("target", "เด็กในเขตรับผิดชอบ (คน)"),
    ("examined", "ได้รับการตรวจฟัน (คน)"),
    ("examined_pct", "ร้อยละได้รับการตรวจฟัน"),
    ("qualified", "ผ่านเกณฑ์คุณภาพ (คน)"),
    ("qualified_pct", "ร้อยละผ่านเกณฑ์คุณภาพ"),
    ("hospitals", "จำนวนหน่วยบริการ"),
    ("districts", "จำนวนอำเภอ"),
    ("date_min", "วันที่ตรวจแรกสุด"),
    ("date_max", "วันที่ตรวจล่าสุด"),
    ("as_of", "วันที่ออกรายงาน"),
]

# Findings: thresholds and word lists.
HIGHER_IS_BETTER = ["ปราศจาก", "ฟันดี", "ปกติ", "ฟันที่มีในปาก"]
PRIMARY_WORDS = ["ปราศจาก", "ผุถอนอุด"]
SMALL_BASE = 30
MIN_GAP = 2.0
GOOD_FROM = 90
WARN_FROM = 75
TONE_LABELS = {"good": "ดี", "warn": "เฝ้าระวัง", "bad": "ต้องแก้ไข", "info": "ข้อมูล"}

# Findings: column headings and sentences (format_string patterns).
FINDING_COLUMNS = {"table": "ตาราง", "level": "ระดับ", "item": "รายการ",
                   "status": "สถานะ", "text": "ข้อสรุป"}
TABLE_HEAD = "ตารางที่ %s %s"
SUMMARY_LEVEL = "ภาพรวม"
NO_FINDINGS = "ไม่มีข้อสรุป"
ROW_OF_AGE = "%s ปี"
ROW_OF_BAND = "กลุ่ม %s ปี"
POINTS, TEETH = "จุด", "ซี่"
HIGHER, LOWER = "สูงกว่า", "ต่ำกว่า"
BETTER, WORSE = "ดีกว่า", "แย่กว่า"
FELL, ROSE = "ลดลง", "เพิ่มขึ้น"
LOWEST, HIGHEST = "ต่ำสุด", "สูงสุด"
OLDER_IS_WORSE, OLDER_IS_BETTER = "ยิ่งอายุมากยิ่งแย่ลง", "ยิ่งอายุมากยิ่งดีขึ้น"
S_QUALITY = ("ภาพรวมผ่านเกณฑ์คุณภาพ %s%% (%s จาก %s คน) "
             "— ข้อมูลที่ตกเกณฑ์ %s คนจะไม่ถูกนับในตารางถัดไป")
S_QUALITY_RANGE = "%s ผ่านเกณฑ์ต่ำสุด %s%% ขณะที่ %s สูงสุด %s%% — ต่างกัน %s จุด"
S_CAUSE = "สาเหตุที่ตกเกณฑ์มากที่สุดคือ “%s” %s รายการ"
S_CAUSE_SHARE = " (≈%s%% ของที่ตกเกณฑ์)"
S_CAUSE_HINT = " — ใช้ปุ่ม “ไม่ผ่านเกณฑ์” ในตารางภาพรวมเพื่อดูรายชื่อ"
S_ROW_QUALITY = "ผ่านเกณฑ์ %s%%"
S_ROW_QUALITY_GAP = " (%sภาพรวม %s จุด)"
S_ROW_QUALITY_FAILED = " · ตกเกณฑ์ %s คน"
S_OVERALL = "ภาพรวมทุกอายุ: %s = %s%s"
S_TREND = "%s เปลี่ยนจาก %s%s ที่ %s เป็น %s%s ที่ %s (%s %s %s) — %s"
S_FOCUS = "ควรเน้น %s — %s %s%s (%s) เทียบกับ %s ที่ %s%s"
S_STEP = "เปลี่ยนแปลงเร็วที่สุดช่วง %s → %s (%s %s) — เป็นช่วงที่ควรแทรกแซงก่อนสาย"
S_TOP = "รายการที่พบมากที่สุดคือ %s = %s%s"
S_SMALL = "ฐานข้อมูลน้อย ควรระวังการตีความ: "
S_SMALL_ROW = "%s (%s คน)"
S_ROW = "%s %s%s"
S_ROW_GAP = " (%sภาพรวม %s %s)"
S_ROW_STANDOUT = " · เด่น: %s %s%s (สูงกว่าภาพรวม %s %s)"
S_ROW_SMALL = " · ฐานเพียง %s คน"

# The typed columns of a record.
NUMERIC_COLUMNS = [
    "pteeth", "pcaries", "pfilling", "pextract",
    "dteeth", "dcaries", "dfilling", "dextract",
    "need_fluoride", "need_scaling", "need_sealant",
    "need_pfilling", "need_dfilling", "need_pextract", "need_dextract",
    "nprosthesis", "permanent_permanent", "permanent_prosthesis",
    "prosthesis_prosthesis",
]
TIME_COLUMNS = ["date_serv", "birth", "d_update"]
CODE_COLUMNS = [
    "hoscode", "pid", "cid", "sex", "denttype", "servplace",
    "gum", "schooltype", "class", "provider", "providertype",
]
