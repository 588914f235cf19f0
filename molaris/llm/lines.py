"""Repeated runs of lines, found by winnowing over line hashes, in Spark expressions.

A document is the sequence of its lines that have a word. In each window of ``window`` lines the line with
the smallest hash (the last of equals) is the window's fingerprint, so two equal runs of at least ``window``
lines always share one: windows whose fingerprint occurs at one place only have no match and are sorted out. The others
meet by the hash of their whole content; windows of equal content that overlap make up the maximal run. Every window
but the first of its content, in order of (document id, position), is a later repeat: its lines are deleted. No group
of positions is paired out.

With ``words``, runs of fewer lines than a window that have at least so many words go by the same rule, so that
a long passage written as one or two lines is found and short common lines stay.

* Blank lines are no part of a run; they stay. A line is compared as it stands.
* Null text stays null and has no line. Null ids come after all others. Rows equal in id and text are the
  same document and get the same result; of two texts with one id the order is by their hash.
* Without ``words``, a document of fewer lines than a window has no run and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molaris.llm.common import free_name, packed_row, written

WINDOW = 3
HAS_WORD = r"[^\\x20\\x09-\\x0D]"
BLANKS = r"[\\x20\\x09-\\x0D]+"


def sequences(df: DataFrame, text: str, doc_id: str, counted: bool = False) -> DataFrame:
    """(doc, key, h): id, hash of id and text, and the hashes of the lines with a word; if counted, also n: their words."""
    own = rf"filter(split(`{text}`, '\n'), x -> x RLIKE '{HAS_WORD}')"
    found = [
        F.col(f"`{doc_id}`").alias("doc"),
        F.expr(f"xxhash64(`{doc_id}`, `{text}`)").alias("key"),
        F.expr(f"transform({own}, x -> xxhash64(x))").alias("h"),
    ]
    if counted:
        found.append(F.expr(f"transform({own}, x -> size(filter(split(x, '{BLANKS}'), w -> w <> '')))").alias("n"))
    return df.select(*found)


def windows(lines: DataFrame, window: int, words: int | None = None) -> DataFrame:
    """One row per window (of at least so many words): its place, its fingerprint with position, and a hash of its content."""
    minimum = "least({})".format(", ".join(f"struct(h[i + {k}] AS print, -(i + {k}) AS back)" for k in range(window)))
    if window == 1:
        minimum = "struct(h[i] AS print, -i AS back)"
    content = ", ".join(f"h[i + {k}]" for k in range(window))
    starts = f"sequence(0, size(h) - {window})"
    if words is not None:
        starts = f"filter({starts}, i -> {' + '.join(f'n[i + {k}]' for k in range(window))} >= {words})"
    made = lines.filter(F.size("h") >= window).select("doc", "key", F.expr(f"""
        explode(transform({starts}, i -> struct(
            i AS at, {minimum} AS least, xxhash64({content}) AS c1, xxhash64('2', {content}) AS c2)))""").alias("w"))
    # nulls compare as smaller, so the flag comes first
    place = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("key").alias("key"), F.col("w.at").alias("at"))
    return made.select(
        "doc", "key", place.alias("place"), F.col("w.at").alias("at"), F.col("w.least.print").alias("print"),
        F.expr("-w.least.back").alias("print_at"), F.col("w.c1").alias("c1"), F.col("w.c2").alias("c2"),
        F.lit(window).alias("size"))


def later_windows(lines: DataFrame, window: int, words: int | None = None) -> DataFrame:
    """(doc, key, at, size): windows whose content stands at an earlier place as well; with words, also the shorter
    ones that have so many."""
    every = windows(lines, window)
    for size in range(1, window if words is not None else 1):
        every = every.unionByName(windows(lines, size, words))
    # a fingerprint selected at one place only cannot match
    repeated = every.groupBy("print").agg(
        F.min(F.struct("doc", "key", "print_at")).alias("low"), F.max(F.struct("doc", "key", "print_at")).alias("high"),
    ).filter("low <> high").select("print")
    matched = every.join(repeated, "print", "left_semi")
    first = matched.groupBy("print", "c1", "c2").agg(F.min("place").alias("first"))
    return matched.join(first, ["print", "c1", "c2"]).filter("place > first").select("doc", "key", "at", "size")


def deduplicated(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, words: int | None = None,
) -> tuple[DataFrame, str]:
    """The table with later repeated runs deleted from its text, and the name of an added struct column:
    n_lines (with a word), removed (their indices among these), n_runs (maximal deleted runs). A run has at least
    ``window`` lines or, if given, ``words`` words."""
    out = free_name(df, "lines")
    lines = written(sequences(df, text, doc_id, words is not None).distinct(), "lines")
    spans = later_windows(lines, window, words).groupBy("doc", "key").agg(F.collect_set(F.struct("at", "size")).alias("_l_at"))
    found = spans.select(F.col("doc").alias("_l_doc"), F.col("key").alias("_l_key"), F.expr(
        "array_sort(array_distinct(flatten(transform(_l_at, s -> sequence(s.at, s.at + s.size - 1)))))").alias("_l_gone"))
    # the row is kept in one column, so no name of its own can clash
    keyed = df.select(packed_row(df), F.col(f"`{doc_id}`").alias("_l_id"), F.expr(f"xxhash64(`{doc_id}`, `{text}`)").alias("_l_own"))
    on = F.col("_l_id").eqNullSafe(F.col("_l_doc")) & (F.col("_l_own") == F.col("_l_key"))
    joined = keyed.join(found, on, "left")
    split = joined.select(
        "_row", "_l_gone",
        F.expr(rf"split(_row.`{text}`, '\n')").alias("_l_lines"),
    ).select(
        "_row", "_l_gone", "_l_lines",
        F.expr(f"filter(sequence(0, size(_l_lines) - 1), i -> _l_lines[i] RLIKE '{HAS_WORD}')").alias("_l_index"),
    )
    rest = split.select(
        "_row", "_l_gone", "_l_lines", "_l_index",
        F.expr("""CASE WHEN _l_gone IS NOT NULL THEN array_except(
            sequence(0, size(_l_lines) - 1), transform(_l_gone, p -> _l_index[p])) END""").alias("_l_rest"),
    )
    left = F.expr(rf"""CASE WHEN _l_rest IS NULL THEN _row.`{text}`
        ELSE array_join(transform(_l_rest, i -> _l_lines[i]), '\n') END""")
    return rest.select(
        *[left.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in df.columns],
        F.struct(
            F.expr("CAST(coalesce(size(_l_index), 0) AS BIGINT)").alias("n_lines"),
            F.expr("coalesce(_l_gone, CAST(array() AS ARRAY<INT>))").alias("removed"),
            F.expr("""CAST(coalesce(size(filter(_l_gone, (p, k) ->
                k = 0 OR p - 1 <> _l_gone[greatest(k - 1, 0)])), 0) AS BIGINT)""").alias("n_runs"),
        ).alias(out)), out
