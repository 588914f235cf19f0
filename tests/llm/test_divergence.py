import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from checks.compare import compare
from molaris.llm import divergence, queries

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string"


def terms_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, least=divergence.LEAST):
    """rows: (text, lang, source); the contract word for word in Python's whole numbers."""
    docs, own, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = terms_of(text)
        own[lang, source].update(found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        mine = sorted(s for x, s in groups if x == lang)
        v = len(kept)

        def chance(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * v) for t in kept}

        p = {s: chance(own[lang, s]) for s in mine}
        q = chance(sum((own[lang, s] for s in mine), Counter()))
        for s in mine:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_chances_are_exact():
    rnd = random.Random(4)
    for top in (10, 10**6, 10**12, 4 * 10**17):
        n = [rnd.randrange(top) for _ in range(50)]
        total = [x + rnd.randrange(top) for x in n]
        found = divergence.chances(np.array(n), np.array(total), 77)
        assert found.tolist() == [1 + 10**9 * (x + 5) // (t + 5 * 77) for x, t in zip(n, total)]


def test_equal_subtrees_are_one_node():
    leaves = np.array([[1, 2, 1, 2, 0, 0, 0, 0], [1, 2, 1, 2, 1, 2, 1, 2], [0] * 8])
    nodes = divergence.Nodes(leaves)
    assert [len(a) for a, _ in nodes.children] == [2, 2, 3]  # (1, 2) and (0, 0); a pair of each; three roots
    rnd = np.random.default_rng(5)
    leaves = rnd.integers(0, 3, (6, 64))
    total = leaves.sum(axis=1)
    first, second = np.triu_indices(6, 1)
    chance = divergence.chances(leaves, total[:, None], 64)
    assert divergence.Nodes(leaves).prices(first, second, total, 64).tolist() == np.abs(chance[first] - chance[second]).sum(axis=1).tolist()


@pytest.mark.parametrize("cells,held,pairs", [(65_536, 400_000, 1_000_000), (100, 50, 64)])
def test_audit_equals_brute_force(spark, monkeypatch, cells, held, pairs):
    for name, value in (("CELLS", cells), ("HELD", held), ("PAIRS", pairs)):
        monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(6)
    vocabulary = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{'x' * (i // 26)}" for i in range(150)]
    rows = []
    for i in range(300):
        lang = rnd.choice(["en", "en", "de", None])
        source = "hot" if rnd.random() < 0.4 else rnd.choice([*"abc", "é", None])
        rows.append((" ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(150)], k=rnd.randint(0, 60))).title(), lang, source))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(4)
    expected = plain(rows, 5)
    assert {p for *_, p, _, _, _ in expected} == {"pair", "term"}
    assert got(divergence.audit(df, least=5)) == expected


def test_op11(spark, sf, docs):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    answer = queries.op11_source_divergence(spark, sf)
    assert got(answer) == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = compare(spark, con, sf, "op11_source_divergence", queries.QUERIES["op11_source_divergence"], queries.SQL_TEXT["op11_source_divergence"])
    assert result.startswith("ok"), result


def test_odd_rows(spark, odd, none):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert got(divergence.audit(odd, least=1)) == plain(rows, 1)
    assert got(divergence.audit(odd)) == plain(rows)  # no term is kept: distances of 0
    assert divergence.audit(none).count() == 0
    named = odd.select("text", "lang", "source", "n_chars").withColumnsRenamed({"text": "term", "lang": "bucket", "source": "n", "n_chars": "total"})
    assert got(divergence.audit(named, "term", "bucket", "n", 2)) == plain(rows, 2)
