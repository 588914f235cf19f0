"""From raw documents to packed sequences, in stages over the whole corpus.

Each stage works on all that the one before kept; between stages the table is written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molaris.llm import lines, packing, quality, secrets, simhash
from molaris.llm.common import table, tune, vocabulary, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    found, q = quality.judged(docs.select(*COLUMNS))
    return found.filter(F.col(f"{q}.kept")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts, and those of one or two lines that have 50 words."""
    found, _ = lines.deduplicated(docs.select(*COLUMNS), words=50)
    return _documents(found)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; their documents stay."""
    _, forest = secrets.scan(docs)
    return _documents(docs.withColumn("text", secrets.redacted(F.col("text"), forest)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document left, with its place in a sequence."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


def _tuned(stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: stage(tune(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _tuned(quality_rules)),
    ("line_dedup", _tuned(line_dedup)),
    ("simhash_near_dedup", _tuned(simhash_near_dedup)),
    ("secret_scan", _tuned(secret_scan)),
    ("packing", _tuned(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: The stages iterate, train a model and encode, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None
