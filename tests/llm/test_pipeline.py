import re
from collections import Counter

from molaris.llm import quality, secrets, wordbpe
from molaris.llm.common import vocabulary
from test_filters import plain_lines, plain_verdicts
from test_search import plain_components, plain_print
from test_tokens import check_packed

import corpus_pipeline


def test_stages_equal_plain_versions(spark, sf, docs):
    """Each stage on all that its predecessor kept, against brute force."""
    df = docs
    rows = {r.doc_id: r for r in df.collect()}
    texts = {d: r.text for d, r in rows.items()}

    counts, failed, distance = plain_verdicts([(r.lang, r.source, r.text) for r in rows.values()])
    texts = {d: t for (d, t), f, x in zip(texts.items(), failed, distance) if not f and (x is None or x <= quality.CUTOFF)}
    texts = {d: x[3] for d, x in plain_lines(list(texts.items()), words=50).items()}
    groups = plain_components([(d, plain_print(t)) for d, t in texts.items()])
    texts = {d: texts[d] for d, _, c in groups if d == c}
    texts = {d: re.sub(r'(?<=token = ")[0-9a-f]{40}', secrets.MASK, t) for d, t in texts.items()}

    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == corpus_pipeline.COLUMNS, name
    after = {r.doc_id: r for r in df.collect()}
    assert {d: r.text for d, r in after.items()} == texts
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (rows[d].lang, rows[d].source) for d, r in after.items())
    assert 100 < len(after) < len(rows)

    lib = wordbpe.Words(vocabulary("word_bpe_49k.json")).lib
    ids = {d: lib.encode(t, add_special_tokens=False).ids + [2] for d, t in texts.items()}
    out = corpus_pipeline.run(spark, sf)
    assert check_packed(out.collect(), ids, 4096) < 0.03


def test_stages_on_odd_rows(spark, sf, odd, none):
    for table in (odd.select(*corpus_pipeline.COLUMNS), odd, none):
        df = table
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf)
            names = Counter(df.columns)
            assert max(names.values()) == 1
            df.collect()


def test_secret_scan_on_rows_with_secrets(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    only = df.filter("text RLIKE '(?i)token = '")
    assert only.count()
    for docs in (df, only):
        after = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, "").collect()}
        assert after == {r.doc_id: re.sub(r'(?i)(?<=token = ")[0-9a-f]{40}', secrets.MASK, r.text) for r in docs.collect()}
