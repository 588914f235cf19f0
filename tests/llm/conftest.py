import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, one long text, and columns that clash."""
    long = " ".join(f"word{i % 997}" for i in range(60_000)) + "\nsame line\nsame line\n"
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", "a", None), (None, "null id text", None, None, 1), (3, " \n\t ", "en", None, 4),
        (4, "a b c d e", None, "a", 9), (5, "a b c d e", "de", "b", 9), (5, "a b c d e", "de", "b", 9), (6, long, "en", "a", len(long)),
        (None, None, None, None, None), (7, "Ünïcødé 日本語 \x1c   <|endoftext|> 😀 don't", "fr", "c", 5), (8, "line\n" * 40, "en", "a", 200),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("quality", "lines", "fingerprint", "component_id", "score", "FP", "length", "value", "part", "key", "split",
                 "_row", "_text", "_counts", "_lang", "_source", "x0", "_q_text", "_q_n", "_q_words", "_l_own", "_l_gone", "_l_doc", "_l_index",
                 "_l_id", "_s_doc", "_s_raw", "_s_spans", "_s_fp", "_s_id", "_s_own", "doc", "h", "n", "at", "term", "bucket", "kept", "total"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
