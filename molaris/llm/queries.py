"""The registered queries over the given tables; SQL_TEXT has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molaris.llm import bpe, divergence, knn, licenses, lines, packing, quality, runs, secrets, simhash, suffix, tokenfile, toxicity
from molaris.llm.common import new_folder, table, tune, vocabulary


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every query (ids divisible by 20)."""
    return knn.top_k(table(spark, sf_dir, "embeddings"), "id % 20 = 0", k=20, scale=64)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the forest's verdict; values as digests."""
    found, _ = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of both."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = docs.select("doc_id", bpe.encoded(F.col("text"), path).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decoded(F.col("ids"), path).alias("bytes"))
    return both.select(
        "doc_id",
        F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.expr("lower(lpad(hex(fp), 16, '0'))").alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels are learnt from four fifths of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rest = "crc32(CAST({} AS STRING)) % 5"
    learn = docs.filter(f"{rest.format('doc_id')} <> 0").select(F.col("doc_id").alias("id"), "text")
    known = labels.filter(f"{rest.format('doc_id')} <> 0").select(F.col("doc_id").alias("id"), "toxic")
    model = toxicity.fit(learn, known)
    scored = docs.select(
        "doc_id", F.expr(f"coalesce({rest.format('doc_id')} = 0, false)").alias("held_out"),
        toxicity.scored(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.expr("CAST(score >= 0.5 AS INT)"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ids as directly addressable codes and read every document back."""
    folder = new_folder(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"))
    return tokenfile.documents(tokenfile.read(spark, folder))


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document, what goes as a repeat of an earlier one, and a digest of what is left."""
    found, out = suffix.repeats_removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = f"CAST(aggregate({out}.removed, 0L, (n, x) -> n + x.end - x.start) AS BIGINT)"
    return found.select(
        "doc_id", F.expr(f"length({out}.kept) + {gone}").alias("n_bytes"), F.expr(gone).alias("n_removed"),
        F.expr(f"CAST(size({out}.removed) AS BIGINT)").alias("n_spans"), F.sha2(F.col(f"{out}.kept"), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def _lines_left(spark: SparkSession, sf_dir: str, words: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, out = lines.deduplicated(docs, words=words)
    return found.select(
        "doc_id", F.col(f"{out}.n_lines").alias("n_lines"),
        F.expr(f"CAST(size({out}.removed) AS BIGINT)").alias("n_removed"), F.col(f"{out}.n_runs").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many are gone in how many runs, and a digest of what is left."""
    return _lines_left(spark, sf_dir)


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; runs of fewer than three lines that have 50 words go as well."""
    return _lines_left(spark, sf_dir, 50)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found, q = quality.judged(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return found.select("doc_id", *[F.col(f"{q}.{n}").alias(n) for n in names])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every source to each other source of its language, and the terms that stand out in it."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document and its text without them; every tenth document, by hash, is made periodic from some word on."""
    words, h = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')", "crc32(CAST(doc_id AS STRING))"
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.expr(f"IF({h} % 10 = 0, named_struct('w', {words}, 'g', {h} DIV 10), NULL)").alias("tenth"))
    first = "CAST(tenth.g % size(tenth.w) AS INT)"
    again = f"CAST(1 + (size(tenth.w) - {first}) DIV (3 + tenth.g % 8) AS INT)"
    planted = docs.select("doc_id", "text", "tenth", F.expr(f"IF(size(tenth.w) > 0, {first}, 0)").alias("a"),
                          F.expr(f"IF(size(tenth.w) > 0, {again}, 1)").alias("p")).select("doc_id", F.expr(
                              "IF(tenth IS NULL, text, array_join(transform(tenth.w, (w, i) -> IF(i < a, w, tenth.w[a + (i - a) % p])), ' '))").alias("text"))
    found, out = runs.found(planted)
    best = found.select("doc_id", out, F.expr(f"""reduce({out}.runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>), (x, y) -> IF(
        x IS NULL OR y.length > x.length OR y.length = x.length AND (y.start < x.start OR y.start = x.start AND y.period < x.period),
        y, x))""").alias("best"))
    listed = f"array_join(transform({out}.runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return best.select(
        "doc_id", F.expr(f"CAST(size({out}.runs) AS BIGINT)").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(F.expr(listed), 256).alias("runs_sha256"),
        F.sha2(f"{out}.collapsed", 256).alias("collapsed_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, template labels and score of every document."""
    found, out = licenses.found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, added = f"transform({out}.mentions, m -> m.label)", f"transform({out}.matches, m -> m.label)"
    return found.select(
        "doc_id", f"{out}.n_words", F.expr(f"CAST(size({out}.mentions) AS BIGINT)").alias("n_base"),
        F.expr(f"array_min(transform({out}.mentions, m -> m.start))").alias("first_word"),
        F.expr(f"array_max(transform({out}.mentions, m -> m.start))").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct({base})), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({base}, {added})), ',')").alias("labels"), f"{out}.score")


Query = Callable[[SparkSession, str], DataFrame]


def _tuned(query: Query) -> Query:
    return lambda spark, sf_dir: query(tune(spark), sf_dir)


_QUERIES: dict[str, Query] = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_secret_scan": op2_secret_scan,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_suffix_arrays": op7_suffix_arrays,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op9_passage_dedup": op9_passage_dedup,
    "op10_quality": op10_quality,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_license_scan": op13_license_scan,
}
QUERIES = {name: _tuned(query) for name, query in _QUERIES.items()}

SQL_TEXT: dict[str, str] = {
    "op1_voronoi_knn": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op9_line_dedup": """
        WITH l AS (
            SELECT doc_id, line, n,
                   CASE WHEN regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')
                        THEN row_number() OVER (PARTITION BY doc_id, regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') ORDER BY n) END AS pos
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                         generate_subscripts(string_split(text, chr(10)), 1) AS n
                  FROM documents)),
        w AS (
            SELECT doc_id, pos, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c
            FROM l WHERE pos IS NOT NULL WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
        f AS (
            SELECT doc_id, pos, first_value(doc_id) OVER k AS fd, first_value(pos) OVER k AS fa
            FROM w WHERE c IS NOT NULL WINDOW k AS (PARTITION BY a, b, c ORDER BY doc_id, pos)),
        g AS (
            SELECT DISTINCT doc_id, pos + k AS pos FROM f, (SELECT unnest([0, 1, 2]) AS k)
            WHERE NOT (doc_id = fd AND pos = fa)),
        r AS (
            SELECT l.doc_id, l.line, l.n, l.pos, g.pos IS NOT NULL AS gone,
                   lag(g.pos IS NOT NULL) OVER (PARTITION BY l.doc_id, l.pos IS NOT NULL ORDER BY l.n) AS before
            FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos)
        SELECT doc_id, count(pos) AS n_lines, count(*) FILTER (gone) AS n_removed,
               count(*) FILTER (gone AND NOT coalesce(before, false)) AS n_runs,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
        FROM r GROUP BY doc_id""",
    "op9_passage_dedup": r"""
        WITH l AS (
            SELECT doc_id, line, n, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
                   CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]')
                        THEN row_number() OVER (PARTITION BY doc_id, regexp_matches(line, '[^\x20\x09-\x0D]') ORDER BY n) END AS pos
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                         generate_subscripts(string_split(text, chr(10)), 1) AS n
                  FROM documents)),
        w AS (
            SELECT doc_id, pos, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c, nw AS na, lead(nw) OVER d AS nb
            FROM l WHERE pos IS NOT NULL WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
        v AS (
            SELECT doc_id, pos, 3 AS size, a, b, c FROM w WHERE c IS NOT NULL
            UNION ALL SELECT doc_id, pos, 2, a, b, '' FROM w WHERE b IS NOT NULL AND na + nb >= 50
            UNION ALL SELECT doc_id, pos, 1, a, '', '' FROM w WHERE na >= 50),
        f AS (
            SELECT doc_id, pos, size, first_value(doc_id) OVER k AS fd, first_value(pos) OVER k AS fa
            FROM v WINDOW k AS (PARTITION BY size, a, b, c ORDER BY doc_id, pos)),
        g AS (
            SELECT DISTINCT doc_id, pos + k AS pos FROM f, (SELECT unnest([0, 1, 2]) AS k)
            WHERE k < size AND NOT (doc_id = fd AND pos = fa)),
        r AS (
            SELECT l.doc_id, l.line, l.n, l.pos, g.pos IS NOT NULL AS gone,
                   lag(g.pos IS NOT NULL) OVER (PARTITION BY l.doc_id, l.pos IS NOT NULL ORDER BY l.n) AS before
            FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos)
        SELECT doc_id, count(pos) AS n_lines, count(*) FILTER (gone) AS n_removed,
               count(*) FILTER (gone AND NOT coalesce(before, false)) AS n_runs,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
        FROM r GROUP BY doc_id""",
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
        l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
        g AS (
            SELECT s.lang, s.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS n
            FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c USING (lang, source) LEFT JOIN k ON k.lang = c.lang AND k.term = c.term
            GROUP BY s.lang, s.source),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.n + 5 * l.v) AS p,
                   1 + 1000000000::HUGEINT * (k.n + 5) // (l.n + 5 * l.v) AS q
            FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        a AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum(abs(x.p - y.p)) AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            UNION ALL
            SELECT x.lang, x.source, 'pair', y.source, 0 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
            WHERE x.lang NOT IN (SELECT lang FROM l)
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM a QUALIFY part = 'pair' OR rank <= 50""",
}
