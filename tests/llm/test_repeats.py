import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from molaris.llm import queries, suffix


def plain(rows, length=50):
    """(doc_id, text) to removed runs: a byte goes if a string of length bytes over it starts in a smaller id."""
    first = {}
    raws = [(suffix.NULL_ID if d is None else d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, dtype=np.int64)
        for i in range(len(raw) - length + 1):
            if first[raw[i:i + length]] < d:
                gone[i:i + length] = 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((list(map(tuple, edge.reshape(-1, 2).tolist())), bytes(np.frombuffer(raw, np.uint8)[gone[:-1] == 0])))
    return out


def got(df):
    found, name = suffix.repeats_removed(df)
    return [(r["doc_id"], r["text"], [tuple(x) for x in r[name].removed], bytes(r[name].kept)) for r in found.collect()]


def same(df, rows):
    expected = [(d, t, runs, kept) for (d, t), (runs, kept) in zip(rows, plain(rows))]
    assert sorted(got(df), key=repr) == sorted(expected, key=repr)


def mixed(rnd, n):
    """Texts that share passages at all kinds of edges, near copies, runs of one character."""
    passages = ["".join(rnd.choice("abcd eé") for _ in range(rnd.randint(40, 200))) for _ in range(12)]
    texts = []
    for i in range(n):
        kind = rnd.randrange(6)
        if kind == 0 and texts:
            t = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, 4)):
                if t:
                    t[rnd.randrange(len(t))] = rnd.choice("xyz")
            texts.append("".join(t))
        elif kind == 1:
            texts.append(rnd.choice(["a", "ab", "日"]) * rnd.randint(0, 150))
        else:
            texts.append("".join(
                rnd.choice(passages)[rnd.randint(0, 60):] if rnd.random() < 0.5 else
                "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 80))) for _ in range(rnd.randint(0, 6))))
    return texts


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n in (60, 300, 900):
        data = rng.integers(97, 99 + n % 3, n).astype(np.uint8)
        data[n // 3:n // 3 + 25] = data[:25]
        order = suffix.suffix_array(data)
        raw = data.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        shared = suffix.common_prefixes(data, order, np.array([0]), np.array([n]), 50)
        for k in range(1, n):
            a, b = raw[order[k - 1]:], raw[order[k]:]
            m = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(m, 50)


@pytest.mark.parametrize("crowd", [4096, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "SHARD", 2000)
    monkeypatch.setattr(suffix, "TOGETHER", 700)
    monkeypatch.setattr(suffix, "ANCHORS", 60)
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rnd = random.Random(crowd)
    rows = [(3 * i % 200, t) for i, t in enumerate(mixed(rnd, 200))]
    same(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), rows)


def test_op7(spark, sf, texts):
    rows = list(texts.items())
    expected = {d: (len(t.encode()), runs, kept) for (d, t), (runs, kept) in zip(rows, plain(rows))}
    answer = queries.op7_suffix_arrays(spark, sf).collect()
    assert len(answer) == len(rows)
    for r in answer:
        n, runs, kept = expected[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, sum(b - a for a, b in runs), len(runs))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert any(r.n_spans for r in answer)


def test_repeats_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same(odd, rows)
    assert suffix.repeats_removed(none)[0].count() == 0
    one = "this passage is long enough to be found again in another document " * 2
    rows = [(1, one), (1, one + "x"), (1, one), (None, one), (None, "y" + one), (2, one[:49]), (3, one[:50]), (-4, "z" + one[3:80])]
    same(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_anchors_of_a_whole_batch_take_little_memory():
    """Texts that are compared together are laid out a slice at a time: 4 MB took 215 MB at once."""
    rnd = random.Random(5)
    parts = [(i, 0, rnd.randbytes(4000).hex().encode()) for i in range(500)]
    tracemalloc.start()
    suffix._anchor_columns(parts, suffix.LENGTH, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20


@pytest.mark.parametrize("repeated", [False, True])
def test_anchors_do_not_depend_on_the_slices(monkeypatch, repeated):
    rnd = random.Random(6)
    parts = [(i, 7 * i, bytes(rnd.choices(b"ab", k=rnd.choice([50, 90, 400])))) for i in range(60)]
    whole = suffix._anchor_columns(parts, suffix.LENGTH, repeated)
    monkeypatch.setattr(suffix, "SLICE", 500)
    for a, b in zip(whole, suffix._anchor_columns(parts, suffix.LENGTH, repeated)):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_long_texts_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 300)
    rows = list(enumerate(mixed(random.Random(7), 40)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(df, rows)
