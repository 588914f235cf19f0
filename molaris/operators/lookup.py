"""Facility dimension: one row per key, and a left lookup that survives large sides."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from molaris.functions import text
from molaris.functions.sql import quoted
from molaris.operators.clean import tidy_headers
from molaris.plans.labels import UNKNOWN_AREA

# The columns of the facility dimension; the named areas carry a number prefix.
FACILITY_COLUMNS = ["hoscode", "hosname", "hostype", "ampcode", "ampname",
                    "pvcode", "pvname", "tumcode", "tumbonname"]
PREFIXED_COLUMNS = ["ampname", "pvname", "tumbonname"]

# A dimension is broadcast up to this measured size of its values, and beyond it while the table made of it stays under
# this share of the smallest heap that has to hold it.
BROADCAST_BYTES = 32 * 1024 * 1024
BROADCAST_ROWS = 250_000
BROADCAST_SHARE = 0.15
# Bytes that a row of such a table takes besides its values: key, pointers and slots, and for each column its place.
ROW_BYTES, COLUMN_BYTES = 96, 12

# Keys that may count as hot, and how many the sketch that finds them tracks (a power of two): it misses no key with more
# than 4 / TRACKED of the rows.
HOT_KEYS = 256
TRACKED = 8192
SPREAD = 8

_MEASURED: WeakKeyDictionary[DataFrame, bool] = WeakKeyDictionary()


def first_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per non-null key: the one that comes first by ``order``.

    A grouped ``min_by`` combines on the map side, so a hot key is not collected.
    """
    rest = [c for c in df.columns if c != key]
    return (
        df.where(F.col(key).isNotNull())
        .withColumn("_order", order)
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.col("_order")).alias("_first"))
        .select(key, *[F.col(f"_first.`{c}`").alias(c) for c in rest])
        .select(*df.columns)
    )


def conform_facilities(df: DataFrame, order: Column) -> DataFrame:
    """Known columns, trimmed keys, plain area names, one row per facility.

    Keys are trimmed before duplicates are dropped, so padded codes cannot fan out a join.
    """
    df = tidy_headers(df.withColumn("_order", order))
    keep = [c for c in FACILITY_COLUMNS if c in df.columns]
    cleaned = df.select(
        *[
            F.expr(text.strip(c)).alias(c) if c == "hoscode"
            else F.expr(text.drop_number_prefix(c)).alias(c) if c in PREFIXED_COLUMNS
            else F.col(c)
            for c in keep
        ],
        "_order",
    )
    return first_per_key(cleaned, "hoscode", F.col("_order")).drop("_order")


def smallest_heap(spark: SparkSession) -> int:
    """Bytes of the smaller of the driver's heap and an executor's; the driver builds a broadcast table, executors keep it."""
    driver = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    if spark.sparkContext.master.split("[")[0] == "local":
        return driver
    executor = spark.sparkContext.getConf().get("spark.executor.memory", "1g")
    return min(driver, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(executor))


def fits_broadcast(df: DataFrame) -> bool:
    """Measured check, once for each table: do its rows and bytes stay under the broadcast bounds, or the table made of
    them under its share of memory? A shuffle join instead sends every record, with all of its columns, through the disks."""
    if df not in _MEASURED:
        width = " + ".join(f"coalesce(octet_length(CAST(`{c}` AS STRING)), 0)" for c in df.columns)
        n, size_bytes = df.agg(F.expr("count(1)"), F.expr(f"coalesce(sum({width}), 0)")).first()
        small = n <= BROADCAST_ROWS and size_bytes <= BROADCAST_BYTES
        made = size_bytes + n * (ROW_BYTES + COLUMN_BYTES * len(df.columns))
        _MEASURED[df] = small or made <= BROADCAST_SHARE * smallest_heap(df.sparkSession)
    return _MEASURED[df]


def hot_keys(facts: DataFrame, key: str, parts: int) -> dict[str, int]:
    """Keys with more than half of a fair task's rows, and how many salts each is dealt over: one pass over the key column
    with a frequent-items sketch."""
    found, rows = facts.agg(
        F.expr(f"approx_top_k(CAST(`{key}` AS STRING), {HOT_KEYS}, {TRACKED})"), F.count(key)).first()
    fair = max(rows / parts, 1)
    # many salts for each fair share, as they fall on tasks by hash; all together at most SPREAD for each task and hot key
    return {r["item"]: int(SPREAD * r["count"] / fair) + 1 for r in found or [] if r["item"] is not None and 2 * r["count"] > fair}


def left_lookup(facts: DataFrame, dim: DataFrame, key: str, broadcast: bool | None = None) -> DataFrame:
    """Left join to a dimension with unique keys.

    Broadcast when the measured size allows. Otherwise a shuffle join by key and salt. Rows of a hot key are dealt over
    as many salts as their share asks for, and only its row of the dimension is there once for each salt. Rows without a
    key get one of their own that no row of the dimension has. The salt is made from the row and its input split, so a
    task that runs again deals its rows out in the same way.
    """
    if fits_broadcast(dim) if broadcast is None else broadcast:
        return facts.join(F.broadcast(dim), key, "left")
    spark = facts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = hot_keys(facts, key, parts)
    dealt = "CASE " + " ".join(f"WHEN `{key}` = {quoted(k)} THEN {n}" for k, n in salts.items()) + " ELSE 1 END" if salts else "1"
    own = ", ".join(f"`{c}`" for c, kind in facts.dtypes if not kind.startswith(("map", "variant")))
    mixed = f"xxhash64(spark_partition_id(), {own})"
    taken = {c.lower() for c in [*facts.columns, *dim.columns]}
    code, salt = next((f"_key{i}", f"_salt{i}") for i in range(len(taken) + 1) if not {f"_key{i}", f"_salt{i}"} & taken)
    keyed = facts.withColumns({
        code: F.expr(f"coalesce(CAST(`{key}` AS STRING), concat('\\u0000', pmod({mixed}, {4 * parts})))"),
        salt: F.expr(f"IF(`{key}` IS NULL, 0, CAST(pmod({mixed}, {dealt}) AS INT))")})
    copies = dim.withColumnRenamed(key, code).withColumn(
        salt, F.explode(F.expr(f"sequence(0, {dealt.replace(f'`{key}`', f'`{code}`')} - 1)")))
    return keyed.join(copies.hint("merge"), [code, salt], "left").drop(code, salt)


def attach_area(df: DataFrame, facilities: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Join the facility dimension; records without a known facility are kept.

    Columns both sides have keep the record's value, the dimension's get the suffix
    ``_ref``; a blank ``hosname`` is filled from it, blank province and district get a name.
    """
    own = set(df.columns)
    dim = facilities.select(
        "hoscode",
        *[F.col(c).alias(f"{c}_ref" if c in own else c) for c in facilities.columns if c != "hoscode"],
    )
    if broadcast is None:
        broadcast = fits_broadcast(facilities)
    out = left_lookup(df.withColumn("hoscode", F.expr(text.strip("hoscode"))), dim, "hoscode", broadcast)
    fills = {}
    if "hosname_ref" in out.columns:
        fills["hosname"] = F.coalesce("hosname", "hosname_ref")
    for c in ("pvname", "ampname"):
        if c in out.columns:
            fills[c] = F.coalesce(F.col(c), F.lit(UNKNOWN_AREA))
    # The record's own columns first, in their order, then the dimension's.
    ordered = [c for c in df.columns] + [c for c in dim.columns if c != "hoscode"]
    return out.withColumns(fills).select(*[F.col(f"`{c}`") for c in ordered])
