"""Quality rules: fixed base rules, then robust multivariate outliers, all in Spark expressions.

Each document gets counts of its words, symbols, repeated lines and repeated word windows. Documents that
pass the base rules are described by four transformed statistics. For every (language, source) group the
minimum covariance determinant estimate of these is sought by concentration steps: take an estimate, keep the closest
``SUBSET`` of the group, take mean and covariance of what was kept, and again until no determinant changes. There are two
starts, medians with median deviations and plain moments; the one that ends with the smaller determinant counts. A
document is rejected if its Mahalanobis distance is beyond ``CUTOFF``.

* Covariances get ``FLOOR`` squared on the diagonal: most clean texts have no symbol or repeated line at
  all, and a zero variance would reject the first one that has.
* Medians and subset bounds are read off histograms of fixed steps, so they do not depend on the order in
  which rows arrive, and a group of any size is summed before it is shuffled. A step is one pass: sums of each bucket of
  distances, added up to the bound.
* A group of fewer than ``MIN_GROUP`` documents that pass the base rules is judged by the estimate of all documents of its
  language, and where these are fewer, by that of all documents. Only if there are fewer at all is none rejected.
* A null text has no words and fails the base rules. Null language or source is a group of its own.
* Repeated rows each get the same verdict; null ids do no harm, as nothing is joined by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from molaris.llm.common import free_name, packed_row, written

WORD_GAP = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: One smallest deviation per statistic: log word length, root shares of symbols, lines, windows.
FLOOR = (0.05, 0.04, 0.15, 0.15)
SUBSET = 0.75
#: SUBSET / P(chi2 with 6 degrees <= its 0.75 quantile with 4): makes the subset's covariance consistent.
CONSISTENCY = 1.4853
MAX_STEPS = 12
#: Logarithms of determinants that differ by less are the same.
STABLE = 1e-9
#: About the 1 - 1e-6 quantile of chi2 with 4 degrees.
CUTOFF = 33.4
MIN_GROUP = 20
#: Groups up to this number are broadcast (about 200 bytes each); more are joined by shuffling.
BROADCAST_GROUPS = 20_000

DIMS = len(FLOOR)
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def counted(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add a struct of the counts of every whole text. The names starting with ``_q`` are dropped again."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    words = df.select(
        *kept,
        F.expr(f"coalesce(`{text}`, '')").alias("_q_text"),
        F.expr(f"array_remove(split(coalesce(`{text}`, ''), '{WORD_GAP}'), '')").alias("_q_words"),
    )
    # the hash of each window of words; a text without an equal pair of hashes is done
    hashed = words.select(
        *kept,
        F.expr("CAST(size(_q_words) AS BIGINT)").alias("_q_n"),
        F.expr("CAST(length(array_join(_q_words, '')) AS BIGINT)").alias("_q_chars"),
        F.expr(f"CAST(length(_q_text) - length(translate(_q_text, '{SYMBOLS}', '')) AS BIGINT)").alias("_q_symbols"),
        F.expr(r"filter(split(_q_text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')").alias("_q_lines"),
        F.expr("transform(_q_words, x -> xxhash64(x))").alias("_q_hashes"),
    )
    window = ", ".join(f"_q_hashes[i + {k}]" for k in range(WINDOW))
    windows = hashed.select(
        *kept, "_q_n", "_q_chars", "_q_symbols",
        F.expr("CAST(size(_q_lines) AS BIGINT)").alias("_q_n_lines"),
        F.expr("CAST(size(_q_lines) - size(array_distinct(_q_lines)) AS BIGINT)").alias("_q_dup_lines"),
        F.expr(f"""CASE WHEN size(_q_hashes) > {WINDOW}
            THEN transform(sequence(0, size(_q_hashes) - {WINDOW}), i -> xxhash64({window})) END""").alias("_q_windows"),
    )
    plain = [*kept, "_q_n", "_q_chars", "_q_symbols", "_q_n_lines", "_q_dup_lines"]
    ordered = windows.select(
        *plain,
        F.expr("""CASE WHEN size(array_distinct(_q_windows)) < size(_q_windows)
            THEN array_sort(transform(_q_windows, (x, i) -> struct(x AS hash, i AS at))) END""").alias("_q_ordered"),
    )
    starts = ordered.select(
        *plain,
        F.expr("""array_sort(transform(
            filter(sequence(0, size(_q_ordered) - 1), k ->
                coalesce(get(_q_ordered, k).hash = get(_q_ordered, k - 1).hash, false)
                OR coalesce(get(_q_ordered, k).hash = get(_q_ordered, k + 1).hash, false)),
            k -> get(_q_ordered, k).at))""").alias("_q_starts"),
    )
    return starts.select(
        *kept,
        F.struct(
            F.col("_q_n").alias("n_words"),
            F.col("_q_chars").alias("word_chars"),
            F.col("_q_symbols").alias("n_symbols"),
            F.col("_q_n_lines").alias("n_lines"),
            F.col("_q_dup_lines").alias("n_dup_lines"),
            F.expr(f"""CASE WHEN _q_starts IS NULL THEN 0L ELSE aggregate(
                sequence(0, size(_q_starts) - 1), 0L,
                (n, k) -> n + least({WINDOW}, coalesce(get(_q_starts, k + 1) - get(_q_starts, k), {WINDOW}))) END
            """).alias("n_repeat_words"),
        ).alias(into),
    )


def statistics(q: str) -> list[Column]:
    """The transformed statistics of the counts in struct column q."""
    return [
        F.expr(f"ln((`{q}`.word_chars + 1.0D) / (`{q}`.n_words + 1.0D))"),
        F.expr(f"sqrt(`{q}`.n_symbols / greatest(`{q}`.word_chars, 1L))"),
        F.expr(f"sqrt(`{q}`.n_dup_lines / greatest(`{q}`.n_lines, 1L))"),
        F.expr(f"sqrt(`{q}`.n_repeat_words / greatest(`{q}`.n_words, 1L))"),
    ]


def _reached(df: DataFrame, keys: list[str], bucket: str, share: float, sums: tuple[str, ...] = ()) -> DataFrame:
    """The first bucket of each group up to which ``share`` of its rows lie (n counts them), with the group's size and
    the sums up to it."""
    w = W.partitionBy(*keys)
    up = w.orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    up_to = df.select(
        *keys, bucket, F.sum("n").over(up).alias("up_to"), F.sum("n").over(w).alias("size"), *[F.sum(c).over(up).alias(c) for c in sums])
    reached = up_to.filter(F.col("up_to") >= F.ceil(F.col("size") * F.lit(share)))
    return reached.groupBy(*keys).agg(F.min_by(F.struct(bucket, "up_to", "size", *sums), bucket).alias("r")).select(*keys, "r.*")


MEDIAN_STEP = 1.0 / 1024
#: Buckets of ln(1 + squared distance), for the subset bound.
BOUND_STEP = 1.0 / 128


KEY = "_group"


def _medians(df: DataFrame) -> DataFrame:
    """Median of every statistic x0, x1, ... of each group, as m0, m1, ..."""
    long = df.select(KEY, F.expr(
        "stack({}, {}) AS (dim, x)".format(DIMS, ", ".join(f"{i}, x{i}" for i in range(DIMS)))
    )).withColumn("bucket", F.expr(f"CAST(round(x / {MEDIAN_STEP}D) AS BIGINT)"))
    counts = long.groupBy(KEY, "dim", "bucket").agg(F.count(F.lit(1)).alias("n"))
    middle = _reached(counts, [KEY, "dim"], "bucket", 0.5)
    return middle.groupBy(KEY).agg(
        *[F.max(F.expr(f"CASE WHEN dim = {i} THEN bucket * {MEDIAN_STEP}D END")).alias(f"m{i}") for i in range(DIMS)])


def _factored(estimate: DataFrame, start: int | None = None) -> DataFrame:
    """From means m* and covariances c* to means, the Cholesky factor l* and the logarithm of the determinant."""
    out = estimate if start is None else estimate.withColumn("start", F.lit(start))
    for i in range(DIMS):
        for j in range(i + 1):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            value = f"sqrt(c{i}{i}{inner})" if i == j else f"(c{i}{j}{inner}) / l{j}{j}"
            out = out.withColumn(f"l{i}{j}", F.expr(value))
    spread = " + ".join(f"2 * ln(l{i}{i})" for i in range(DIMS))
    return out.select(KEY, "start", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in _PAIRS], F.expr(spread).alias("spread"))


_SUMS = tuple([f"s{i}" for i in range(DIMS)] + [f"p{i}{j}" for i, j in _PAIRS])


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)],
        *[F.sum(F.expr(f"x{i} * x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS])


def _moments(sums: DataFrame, n: str, factor: float, *keys: str) -> DataFrame:
    """Means and covariances, with the floor, from sums."""
    return sums.select(
        *keys, *[F.expr(f"s{i} / {n}").alias(f"m{i}") for i in range(DIMS)],
        *[F.expr(f"(p{i}{j} / {n} - (s{i} / {n}) * (s{j} / {n})) * {factor}D + {FLOOR[i] ** 2 if i == j else 0.0}D").alias(f"c{i}{j}") for i, j in _PAIRS])


def _distances(df: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance; null without an estimate."""
    out = df
    for i in range(DIMS):
        inner = "".join(f" - l{i}{k} * y{k}" for k in range(i))
        out = out.withColumn(f"y{i}", F.expr(f"(x{i} - m{i}{inner}) / l{i}{i}"))
    return out.withColumn("d2", F.expr(" + ".join(f"y{i} * y{i}" for i in range(DIMS)))).drop(
        *[f"y{i}" for i in range(DIMS)], *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in _PAIRS], "spread")


def _named(level: int, *columns: str) -> str:
    """The name of a group: of a source, of a language, or of all."""
    return "to_json(struct({} AS level{}), map('ignoreNullFields', 'false'))".format(level, "".join(f", {c}" for c in columns))


def groups(stats: DataFrame) -> DataFrame:
    """(_lang, _source, own, pools): the group that judges a (language, source), and all that its documents count in."""
    sizes = stats.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    of_lang, everywhere = W.partitionBy("_lang"), W.partitionBy(F.lit(0))
    level = f"CASE WHEN n >= {MIN_GROUP} THEN 0 WHEN in_lang >= {MIN_GROUP} THEN 1 WHEN in_all >= {MIN_GROUP} THEN 2 END"
    # one row for each group
    placed = sizes.withColumns({"in_lang": F.sum("n").over(of_lang), "in_all": F.sum("n").over(everywhere)}).withColumn(
        "level", F.expr(level)).withColumns({
            "for_lang": F.max(F.expr("level <=> 1")).over(of_lang), "for_all": F.max(F.expr("level <=> 2")).over(everywhere)})
    source, language, all_ = _named(0, "_lang", "_source"), _named(1, "_lang"), _named(2)
    return placed.select(
        "_lang", "_source", F.expr(f"CASE level WHEN 0 THEN {source} WHEN 1 THEN {language} WHEN 2 THEN {all_} END").alias("own"),
        F.expr(f"filter(array(IF(level <=> 0, {source}, NULL), IF(for_lang, {language}, NULL), IF(for_all, {all_}, NULL)), g -> g IS NOT NULL)").alias("pools"))


def _by_source(df: DataFrame, found: DataFrame, broadcast: bool) -> DataFrame:
    on = df["_lang"].eqNullSafe(found["_lang"]) & df["_source"].eqNullSafe(found["_source"])
    right = F.broadcast(found) if broadcast else found
    return df.join(right, on, "left").drop(found["_lang"]).drop(found["_source"])


def estimates(stats: DataFrame) -> DataFrame:
    """Mean and factor of each group of the rows (_group, x0, ...)."""
    centre = written(_medians(stats), "medians")
    small = centre.count() <= BROADCAST_GROUPS

    def near(groups_: DataFrame) -> DataFrame:
        return F.broadcast(groups_) if small else groups_

    gaps = stats.join(near(centre), KEY).select(KEY, *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}") for i in range(DIMS)])
    spread = _medians(gaps).select(KEY, *[F.col(f"m{i}").alias(f"s{i}") for i in range(DIMS)])
    by_medians = centre.join(near(spread), KEY).select(
        KEY, *[f"m{i}" for i in range(DIMS)],
        # 1.4826 median deviations are a standard deviation
        *[F.expr(f"pow(1.4826D * s{i}, 2) + pow({FLOOR[i]}D, 2)" if i == j else "0.0D").alias(f"c{i}{j}") for i, j in _PAIRS])
    by_moments = _moments(_summed(stats, KEY), "n", 1.0, KEY)
    found = written(_factored(by_medians, 0).unionByName(_factored(by_moments, 1)), "start")
    for step in range(MAX_STEPS):
        at = _distances(stats.join(near(found), KEY)).withColumn("bucket", F.expr(f"CAST(floor(ln(1 + d2) / {BOUND_STEP}D) AS BIGINT)"))
        subset = _reached(_summed(at, KEY, "start", "bucket"), [KEY, "start"], "bucket", SUBSET, _SUMS)
        after = written(_factored(_moments(subset, "up_to", CONSISTENCY, KEY, "start")), f"step{step}")
        both = after.join(found.select(KEY, "start", F.col("spread").alias("before")), [KEY, "start"])
        change = both.agg(F.max(F.expr("abs(spread - before)"))).first()[0]
        found = after
        if change is None or change < STABLE:
            break
    columns = [c for c in found.columns if c != KEY]
    return found.groupBy(KEY).agg(F.min_by(F.struct(*columns), F.struct("spread", "start")).alias("e")).select(KEY, "e.*").drop("start")


def judged(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, str]:
    """The table with a struct column added, and its name: the counts, base_failed, distance and kept."""
    q = free_name(df, "quality")
    # the row is kept in one column, so no name of its own can clash
    counts = counted(df.select(packed_row(df), F.col(f"`{text}`").alias("_text")), "_text", "_counts").drop("_text")
    failed = F.expr(f"_counts.n_words < {MIN_WORDS} OR 100 * _counts.n_repeat_words > {MAX_REPEAT_PERCENT} * _counts.n_words")
    table = written(counts.withColumn("_counts", F.col("_counts").withField("base_failed", failed)), "counts")
    described = table.select(
        "_row", "_counts", F.col(f"_row.`{lang}`").cast("string").alias("_lang"), F.col(f"_row.`{source}`").cast("string").alias("_source"),
    ).select("*", *[x.alias(f"x{i}") for i, x in enumerate(statistics("_counts"))])
    good = described.filter("NOT _counts.base_failed").select("_lang", "_source", *[f"x{i}" for i in range(DIMS)])
    of_group = written(groups(good), "groups")
    small = of_group.count() <= BROADCAST_GROUPS
    stats = written(_by_source(good, of_group, small).select(F.explode("pools").alias(KEY), *[f"x{i}" for i in range(DIMS)]), "stats")
    found = written(estimates(stats), "estimates")
    owned = of_group.select("_lang", "_source", "own").join(F.broadcast(found) if small else found, F.col("own") == F.col(KEY), "left").drop(KEY, "own")
    placed = _distances(_by_source(described, owned, small))
    kept = F.expr(f"NOT _counts.base_failed AND coalesce(d2 <= {CUTOFF}D, true)")
    verdict = F.col("_counts").withField("distance", F.col("d2")).withField("kept", kept)
    return placed.select("_row.*", verdict.alias(q)), q
