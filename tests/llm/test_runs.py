import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from molaris.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words, minimum=runs.MINIMUM):
    """All runs by trying every period: (start, length, period)."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(minimum, 2 * q):
                part = words[i:j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def mixed(rnd, n):
    """Sequences with nested, adjacent and overlapping repetitions."""
    out = []
    while len(out) < n:
        unit = [rnd.randint(0, rnd.choice([1, 3, 30])) for _ in range(rnd.randint(1, 9))]
        out += unit * rnd.randint(1, 7) + unit[:rnd.randint(0, len(unit))]
        if rnd.random() < 0.3 and out:
            out[rnd.randrange(len(out))] = 99
    return out[:n]


def test_tree_ranks_and_extensions():
    rnd = random.Random(1)
    for size in (1, 2, 7, 60, 400):
        s = mixed(rnd, size) + [-1]
        tree = runs.SuffixTree(s)
        assert sorted(range(len(s)), key=lambda i: s[i:]) == sorted(range(len(s)), key=lambda i: tree.rank[i])
        pairs = [(a, b) for a in range(0, len(s), 3) for b in range(0, len(s), 2) if a != b]
        if pairs:
            a, b = map(np.array, zip(*pairs))
            for x, y, shared in zip(a, b, tree.extension(a, b)):
                k = 0
                while max(x, y) + k < len(s) and s[x + k] == s[y + k]:
                    k += 1
                assert k == shared


def test_range_minimum():
    rng = np.random.default_rng(2)
    for n in (1, 15, 16, 17, 100, 1000):
        values = rng.integers(0, 50, n).astype(np.int32)
        low = rng.integers(0, n, 300)
        high = np.minimum(low + rng.integers(0, n, 300), n - 1)
        assert runs.RangeMinimum(values).least(low, high).tolist() == [values[a:b + 1].min() for a, b in zip(low, high)]


@pytest.mark.parametrize("minimum", [2, 12])
def test_all_runs_equal_brute_force(minimum):
    rnd = random.Random(minimum)
    for _ in range(60):
        s = mixed(rnd, rnd.randint(1, 150))
        start, end, period = runs.all_runs(np.array(s) + 1, minimum)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == plain(s, minimum)


def test_stretches_lose_no_run(monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", 70)
    rnd = random.Random(5)
    texts = [mixed(rnd, rnd.randint(0, 90)) if rnd.random() < 0.7 else [rnd.randint(0, 500) for _ in range(60)] for _ in range(80)]
    words = np.array([x for t in texts for x in t])
    document = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, end, period = runs.runs_of(words, document)
    got = sorted(zip(start.tolist(), (end - start).tolist(), period.tolist()))
    base, expected = 0, []
    for t in texts:
        expected += [(s + base, n, q) for s, n, q in plain(t)]
        base += len(t)
    assert got == sorted(expected) and expected


def test_op12(spark, sf, texts):
    answer = queries.op12_periodic_runs(spark, sf).collect()
    assert len(answer) == len(texts)
    some = 0
    for r in answer:
        words = WORD.findall(texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        found = plain([numbers[w] for w in words]) if len(words) < 1500 else None
        if found is None:
            continue
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert r.n_runs == len(found) and (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
        some += bool(found)
    assert some > 5


def test_odd_rows(spark, odd, none):
    df, out = runs.found(odd.withColumn("periodic", F.lit("mine")))
    assert out == "periodic_" and df.columns[:-1] == [*odd.columns, "periodic"]
    rows = df.collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = WORD.findall(r["text"] or "")
        assert r["periodic"] == "mine" and r[out].runs is not None
        if len(words) < 1000:
            found = plain(words)
            assert [tuple(x) for x in r[out].runs] == found and r[out].collapsed == collapsed(words, found)
        else:  # 60,000 words of period 997; the two equal lines at the end are too short for a run
            assert [tuple(x) for x in r[out].runs] == [(0, 60_000, 997)]
    assert runs.found(none)[0].count() == 0
    same = spark.createDataFrame([(1, "a b " * 9), (1, "a b " * 9), (None, "x " * 12), (2, "x " * 11)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, *[tuple(x) for x in r.periodic.runs]) for r in runs.found(same)[0].collect()) == [
        (0, (0, 12, 1)), (1, (0, 18, 2)), (1, (0, 18, 2)), (2,)]
