"""The two rule sets of the public report forms, rules in Spark SQL."""

from __future__ import annotations

from molaris.plans.rules import (
    COUNT_PCT, MEAN, QUALITY, Band, Check, Metric, NameColumn, NameRule, Overview, Profile, Table,
)

SCHOOL_AGE = Profile(
    id="6-12y",
    label="เด็กวัยเรียน 6-12 ปี",
    age_min=6,
    age_max=12,
    quality_filter="providertype IN ('02', '06') AND pteeth > 0",
    quality_checks=(
        Check("provider_type in (02,06)", "providertype IN ('02', '06')"),
        Check("PTEETH > 0", "pteeth > 0"),
    ),
    tables=(
        Table(
            "1", "ข้อมูลคุณภาพของข้อมูลการตรวจแยกรายกลุ่มอายุ", QUALITY,
            conditions=(
                "จำนวนที่ตรวจ (ได้รับการตรวจฟัน) คือ date_serv ไม่เป็นค่าว่าง",
                "ผ่านเกณฑ์คุณภาพ = ได้รับการตรวจฟัน และ provider_type in (02,06) และ PTEETH > 0",
            ),
        ),
        Table(
            "2", "ร้อยละของผู้ปราศจากโรคฟันผุและมีประสบการณ์ฟันผุ", COUNT_PCT,
            metrics=(
                Metric("ปราศจากฟันผุ", "pcaries + pfilling + pextract = 0"),
                Metric("ฟันดีไม่มีผุ", "pcaries + pextract = 0"),
                Metric("ฟันผุไม่ได้รักษา", "pcaries > 0"),
                Metric("ฟันถอน", "pextract > 0"),
                Metric("ฟันอุด", "pfilling > 0"),
                Metric("ฟันผุถอนอุด", "pcaries + pfilling + pextract > 0"),
            ),
            conditions=(
                "ปราศจากฟันผุ = pcaries + pfilling + pextract = 0",
                "ฟันดีไม่มีผุ = pcaries + pextract = 0",
                "ฟันผุไม่ได้รักษา = pcaries > 0 | ฟันถอน = pextract > 0 | ฟันอุด = pfilling > 0",
                "ฟันผุถอนอุด = pcaries + pfilling + pextract > 0",
            ),
        ),
        Table(
            "3", "ค่าเฉลี่ยฟันผุถอนอุดในกลุ่มอายุต่างๆ (ซี่ต่อคน)", MEAN,
            metrics=(
                Metric("ฟันที่มีในปาก", "pteeth"),
                Metric("ฟันผุ", "pcaries"),
                Metric("ฟันถอน", "pextract"),
                Metric("ฟันอุด", "pfilling"),
                Metric("ฟันผุถอนอุด", "pcaries + pfilling + pextract"),
            ),
            conditions=("หารด้วยจำนวนคนที่ตรวจผ่านเกณฑ์คุณภาพ",),
        ),
        Table(
            "4", "ร้อยละของผู้มีภาวะเหงือกอักเสบและสภาวะปริทันต์", COUNT_PCT,
            metrics=(
                Metric("ปกติ", "gum_status <=> '0'"),
                Metric("เลือดออก", "gum_status <=> '1'"),
                Metric("เหงือกอักเสบ", "gum_status <=> '2'"),
                Metric("ปริทันต์", "gum_status <=> '3'"),
                Metric("ตรวจไม่ได้", "gum_status <=> '9'"),
            ),
            conditions=(
                "GUM = 6 sextant รูปแบบ XXXXXX แต่ละ X in (0,1,2,3,9)",
                "gum_status = 9 ถ้า GUM = 999999 มิฉะนั้นใช้ค่าสูงสุดของ sextant ที่ตรวจได้ (0,1,2,3)",
            ),
        ),
        Table(
            "5", "ค่าเฉลี่ย sextant ที่มีเหงือกอักเสบและสภาวะปริทันต์", MEAN,
            metrics=(
                Metric("ปกติ", "gum_sx_0"),
                Metric("เลือดออก", "gum_sx_1"),
                Metric("เหงือกอักเสบ", "gum_sx_2"),
                Metric("ปริทันต์", "gum_sx_3"),
                Metric("ตรวจไม่ได้", "gum_sx_9"),
            ),
            conditions=("1 คนมี 6 sextant นับจำนวน sextant ตามค่าเหงือก แล้วเฉลี่ยต่อคน",),
        ),
        Table(
            "6", "ความจำเป็นในการรักษา", COUNT_PCT,
            metrics=(
                Metric("ทาฟลูออไรด์", "need_fluoride = 1"),
                Metric("เคลือบหลุมร่องฟัน", "need_sealant > 0"),
                Metric("อุดฟัน", "need_pfilling > 0 OR need_dfilling > 0"),
                Metric("ถอนฟัน/รักษารากฟัน", "need_pextract > 0 OR need_dextract > 0"),
                Metric("ขูดหินปูน", "need_scaling = 1"),
            ),
            conditions=(
                "ทาฟลูออไรด์ = need_fluoride = 1 | ขูดหินปูน = need_scaling = 1",
                "เคลือบหลุมร่องฟัน = need_sealant > 0",
                "อุดฟัน = need_pfilling > 0 หรือ need_dfilling > 0",
                "ถอนฟัน/รักษารากฟัน = need_pextract > 0 หรือ need_dextract > 0",
            ),
        ),
    ),
)

PRESCHOOL = Profile(
    id="0-5y",
    label="เด็กก่อนวัยเรียน 0-5 ปี",
    age_min=0,
    age_max=5,
    bands=(Band("0-2", 0, 2), Band("3-5", 3, 5)),
    filename_columns=(
        NameColumn("agegroup", (NameRule("0-2", "a0-2"), NameRule("3-5", "a3-5"))),
    ),
    quality_filter=(
        "providertype IN ('02', '06') AND dteeth >= 1 AND dteeth <= 20 "
        "AND dcaries + dfilling + dextract <= 20"
    ),
    # A full set of milk teeth is expected from about three years on.
    quality_extra=(("3-5", "dteeth + dextract = 20"),),
    quality_checks=(
        Check("provider_type in (02,06)", "providertype IN ('02', '06')"),
        Check("dteeth between 1-20", "dteeth >= 1 AND dteeth <= 20"),
        Check("dcaries+dfilling+dextract <= 20", "dcaries + dfilling + dextract <= 20"),
        Check("dteeth+dextract = 20 (เฉพาะ 3-5 ปี)", "dteeth + dextract = 20", bands=("3-5",)),
    ),
    overview=Overview(
        caries_free="dcaries + dfilling + dextract = 0",
        dmft="dcaries + dfilling + dextract",
        caries_free_label="ปราศจากฟันผุ (ฟันน้ำนม)",
        dmft_label="dmft เฉลี่ย",
    ),
    tables=(
        Table(
            "1", "ข้อมูลคุณภาพของข้อมูลการตรวจแยกรายกลุ่มอายุ", QUALITY, rows="bands",
            conditions=(
                "จำนวนที่ตรวจ (ได้รับการตรวจฟัน) คือ date_serv ไม่เป็นค่าว่าง",
                "ผ่านเกณฑ์คุณภาพ = ตรวจฟัน และ provider_type in (02,06) และ dteeth 1-20 "
                "และ dcaries+dfilling+dextract ≤ 20",
                "เพิ่มเติมสำหรับ 3-5 ปี: dteeth + dextract = 20 (ฟันน้ำนมครบ 20 ซี่)",
            ),
        ),
        Table(
            "2", "ร้อยละของผู้ปราศจากโรคฟันผุและมีประสบการณ์ฟันผุ (ฟันน้ำนม)", COUNT_PCT,
            rows="bands",
            metrics=(
                Metric("ปราศจากฟันผุ", "dcaries + dfilling + dextract = 0"),
                Metric("ฟันดีไม่มีผุ", "dcaries + dextract = 0"),
                Metric("ฟันผุไม่ได้รักษา", "dcaries > 0"),
                Metric("ฟันถอน", "dextract > 0"),
                Metric("ฟันอุด", "dfilling > 0"),
                Metric("ฟันผุถอนอุด", "dcaries + dfilling + dextract > 0"),
            ),
            conditions=(
                "ปราศจากฟันผุ = dcaries + dfilling + dextract = 0",
                "ฟันดีไม่มีผุ = dcaries + dextract = 0",
                "ฟันผุไม่ได้รักษา = dcaries > 0 | ฟันถอน = dextract > 0 | ฟันอุด = dfilling > 0",
                "ฟันผุถอนอุด = dcaries + dfilling + dextract > 0",
            ),
        ),
        Table(
            "3", "ค่าเฉลี่ยฟันผุถอนอุดในกลุ่มอายุต่างๆ (ซี่ต่อคน, ฟันน้ำนม)", MEAN, rows="bands",
            metrics=(
                Metric("ฟันที่มีในปาก", "dteeth"),
                Metric("ฟันผุ", "dcaries"),
                Metric("ฟันถอน", "dextract"),
                Metric("ฟันอุด", "dfilling"),
                Metric("ฟันผุถอนอุด", "dcaries + dfilling + dextract"),
            ),
            conditions=(
                "ฟันที่มีในปาก = dteeth",
                "ค่าเฉลี่ยแต่ละช่อง = ผลรวมของช่องนั้น ÷ จำนวนคนที่ตรวจผ่านเกณฑ์คุณภาพ",
            ),
        ),
        Table(
            "7", "ความจำเป็นในการรักษา", COUNT_PCT, rows="bands",
            metrics=(
                Metric("ทาฟลูออไรด์", "need_fluoride = 1"),
                Metric("เคลือบหลุมร่องฟัน", "need_sealant > 0"),
                Metric("อุดฟัน", "need_dfilling > 0"),
                Metric("ถอนฟัน/รักษารากฟัน", "need_dextract > 0"),
                Metric("ขูดหินปูน", "need_scaling = 1"),
            ),
            conditions=(
                "ทาฟลูออไรด์ = need_fluoride = 1 | ขูดหินปูน = need_scaling = 1",
                "เคลือบหลุมร่องฟัน = need_sealant > 0",
                "อุดฟัน = need_dfilling > 0 | ถอนฟัน/รักษารากฟัน = need_dextract > 0",
            ),
        ),
    ),
)

PROFILES = {p.id: p for p in (SCHOOL_AGE, PRESCHOOL)}
