import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from molaris.llm import knn, queries, simhash
from molaris.llm.components import connected


def best(vectors, query, k):
    out = []
    for vec_id, v in vectors.items():
        if vec_id != query:
            n = max(len(v), len(vectors[query]))
            a, b = v + [0] * (n - len(v)), vectors[query] + [0] * (n - len(vectors[query]))
            out.append((-sum(x * y for x, y in zip(a, b)), vec_id))
    return [(vec_id, -s) for s, vec_id in sorted(out)[:k]]


def check_knn(rows, vectors, ids, k):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == {q: best(vectors, q, k) for q in ids if len(vectors) > 1}


def test_op1(spark, sf):
    vectors = {
        r.vec_id: [int(np.floor(64 * float(x))) for x in r.embedding]
        for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    check_knn(queries.op1_voronoi_knn(spark, sf).collect(), vectors, [i for i in vectors if i % 20 == 0], 20)


def test_knn_replicates_little_on_clusters(spark, monkeypatch):
    """Vectors in narrow clusters: rows go to the groups of their own cluster and of few others; exact all the same."""
    monkeypatch.setattr(knn, "GROUP_QUERIES", 12)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(24, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vectors = {i: (centres[i % 24] + rng.normal(size=32) * 0.01).tolist() for i in range(2400)}
    seen = {}
    original = knn.written

    def noted(df, name):
        out = original(df, name)
        if name == "replicas":
            seen["replicas"], seen["groups"] = out.count(), out.select("grp").distinct().count()
        return out

    monkeypatch.setattr(knn, "written", noted)
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    check_knn(knn.top_k(df, "id % 10 = 0").collect(), {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors.items()},
              [i for i in vectors if i % 10 == 0], 20)
    assert seen["groups"] >= 10 and seen["replicas"] < 0.35 * seen["groups"] * len(vectors), seen


def test_knn_clusters_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP_QUERIES", 7)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 60)
    rnd = random.Random(1)
    vectors = {}
    for i in range(400):
        centre = [(0, 0, 9), (9, 0, 0), (-3, 3, 1)][i % 3]
        vectors[i] = [c + rnd.randint(-1, 1) for c in centre]
    for i in range(400, 520):
        vectors[i] = [9, 0, 0]
    vectors[601], vectors[602], vectors[603] = [], [100], [1, 2, 3, 4]
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()]
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan"), 1.0]), (703, [float("inf")]), (None, [1.0]), (5, [float(x) for x in vectors[5]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("v", F.lit(2))
    check_knn(knn.top_k(df, "id % 10 = 0 OR id > 600", k=6, scale=1).collect(), vectors, [i for i in vectors if i % 10 == 0 or i > 600], 6)
    assert knn.top_k(df.limit(0), "true").count() == 0
    assert knn.top_k(df, "id < 0").count() == 0
    assert knn.top_k(df.filter("vec_id = 1"), "true", scale=1).count() == 0


# SimHash


def plain_print(text, size=4, seed=42):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=4):
    """rows: (doc_id, fingerprint)"""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f, least.get(find(f))) for d, f in rows]


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def test_fingerprint_of_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "_HASHES_AT_ONCE", 300)
    text = " ".join(f"Wörd{i * i % 1013}" for i in range(2000))
    assert simhash.fingerprint_of(text) == plain_print(text)
    for text in ("", "a", "a b c", "a b c d", "A\x0bB\x0cC\x1cD E"):
        assert simhash.fingerprint_of(text) == plain_print(text)


def test_codewords_are_perfect():
    table = simhash.near_codewords()
    assert sorted(set((table >= 0).sum(axis=1))) == [1, 6]


def test_every_link_shares_a_key():
    rnd = random.Random(2)
    for _ in range(1500):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(1, 4)):
            b ^= 1 << bit
        _, k = simhash.keys_of(np.array([a], np.uint64).view(np.int64))
        _, j = simhash.keys_of(np.array([b], np.uint64).view(np.int64))
        assert set(k.tolist()) & set(j.tolist())


def test_op4(spark, sf, texts):
    expected = plain_components([(d, plain_print(t)) for d, t in texts.items()])
    got = queries.op4_simhash(spark, sf).collect()
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == sorted(expected)
    assert len({r.component_id for r in got}) < len(got)


def test_chains_and_crowds(spark, monkeypatch):
    """A chain of links, a crowd around one fingerprint, and lone ones; found links keep components whole."""
    monkeypatch.setattr(simhash, "_PAIRS_AT_ONCE", 1000)
    rnd = random.Random(3)
    prints, f = [], rnd.getrandbits(64)
    for _ in range(60):
        for bit in rnd.sample(range(64), 4):
            f ^= 1 << bit
        prints.append(f)
    centre = rnd.getrandbits(64)
    for _ in range(300):
        g = centre
        for bit in rnd.sample(range(64), rnd.randint(0, 3)):
            g ^= 1 << bit
        prints.append(g)
    prints += [rnd.getrandbits(64) for _ in range(100)]
    rows = [(1000 - i, p) for i, p in enumerate(prints)]
    signed = [(d, p - (1 << 64) if p >> 63 else p) for d, p in rows]
    df = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    got = df.join(simhash.components(df), "fp").collect()
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == sorted(plain_components(rows))


def test_simhash_odd_rows(odd, none):
    rows = [(r.doc_id, plain_print(r.text)) for r in odd.collect()]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(got, key=key) == sorted(plain_components(rows), key=key)
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_one_of_each(spark, odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {
        (1, ""), (None, "null id text"), (4, "a b c d e")} | {(r.doc_id, r.text) for r in odd.collect() if r.doc_id in (6, 7, 8)}
    assert kept.count() == 6
    df = spark.createDataFrame([(None, "x y"), (None, "x  y"), (None, "x y"), (None, "other")], "doc_id bigint, text string")
    assert sorted(r.text for r in simhash.one_of_each(df).collect()) == ["other", "x  y"]


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            root[find(a)] = find(b)
    assert got.keys() == root.keys()
    assert len({(find(n), r) for n, r in got.items()}) == len({find(n) for n in got}) == len(set(got.values()))
