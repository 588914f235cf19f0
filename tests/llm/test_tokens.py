import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from molaris.llm import bpe, dac, packing, queries, tokenfile, wordbpe
from molaris.llm.common import new_folder, vocabulary

RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")
WORDS = vocabulary("word_bpe_49k.json")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "'", "'ll", "l", "é", "日", "本", "1", "23", "!", "%%%", "　", "\x1c", "\x85",
         "́", "😀", "\t", "ß", "<|endoftext|>", "İ", "Σ"]


@pytest.fixture(scope="module")
def small_leaves():
    kept = bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.FIRST_IDS
    bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.FIRST_IDS = 7, 12, 1
    yield bpe.Bpe.load(RANKS)
    bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.FIRST_IDS = kept


def test_pattern_is_that_of_the_files():
    import public_tokenizers

    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_tree_equals_library(small_leaves):
    rnd = random.Random(3)
    for _ in range(1500):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60)))
        ids = small_leaves.encode(text)
        assert ids.tolist() == small_leaves.lib.encode_ordinary(text), text
        assert small_leaves.decode(ids) == text.encode()


def test_one_long_match_equals_library(small_leaves):
    rnd = random.Random(4)
    for _ in range(400):
        text = "".join(rnd.choice("etaoinshrdluéßñ") for _ in range(rnd.randint(0, 300)))
        assert small_leaves.encode(text).tolist() == small_leaves.lib.encode_ordinary(text), text
    for part in ("a", "ab", "the", "xyz ", "日"):
        assert small_leaves.encode(part * 333).tolist() == small_leaves.lib.encode_ordinary(part * 333)


def test_op3(spark, sf, texts):
    lib = bpe.Bpe.load(RANKS).lib
    rows = queries.op3_byte_bpe(spark, sf).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        ids = np.array(lib.encode_ordinary(texts[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_odd_rows(odd, none):
    rows = odd.select("text", bpe.encoded(F.col("text"), RANKS).alias("ids")).select("text", "ids", bpe.decoded(F.col("ids"), RANKS).alias("b"))
    for r in rows.collect():
        assert bytes(r.b) == (r.text or "").encode()
    assert none.select(bpe.encoded(F.col("text"), RANKS)).count() == 0


def plain_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("keep", [400_000, 60])
def test_special_names_are_their_tokens(monkeypatch, keep):
    """As the untouched library does it, wherever the names stand; also when the worker forgets parts all the time."""
    monkeypatch.setattr(wordbpe, "KEEP", keep)
    words, lib = wordbpe.Words(WORDS), plain_library()
    rnd = random.Random(8)
    own = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "the", "A.", "b's", " ", "\n", "日", "é", "<", "|", "\x0b", "x1"]
    for _ in range(60):
        some = ["".join(rnd.choice(own) for _ in range(rnd.randint(0, 12))) for _ in range(20)]
        assert [x.tolist() for x in words.encode(some)] == [lib.encode(t, add_special_tokens=False).ids for t in some]
        assert len(words.words) <= max(keep, 400)
    assert words.encode(["a<|endoftext|>b"])[0].tolist()[1] == 49407


def test_words_equal_library(texts):
    words = wordbpe.Words(WORDS)
    rnd = random.Random(5)
    some = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(800)] + list(texts.values())
    expected = [x.ids for x in plain_library().encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in words.encode(some)] == expected


def test_words_forget(monkeypatch):
    monkeypatch.setattr(wordbpe, "KEEP", 3)
    words = wordbpe.Words(WORDS)
    for text in ("one two three four five", "six one two", "one"):
        assert words.encode([text])[0].tolist() == words.lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_codes(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = rng.integers(0, 2 ** rng.integers(1, 32), n).astype(np.uint32)
        codes = dac.Codes(dac.pack(ids, bits))
        assert len(codes) == n and (codes.slice(0, n) == ids).all()
        for i in rng.integers(0, max(n, 1), min(n, 20)):
            assert codes[int(i)] == ids[i]
            m = int(rng.integers(0, n - i + 1))
            assert (codes.slice(int(i), m) == ids[i:i + m]).all()


def as_read(rows, texts, end):
    lib = plain_library()
    at = 0
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [end]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 5000)
    rows = queries.op6_token_files(spark, sf).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    as_read(rows, texts, 1)


def test_token_files_odd_rows(spark, odd, none):
    for df in (odd, none):
        folder = new_folder(spark, "tokens")
        tokenfile.write(df, folder, WORDS)
        rows = tokenfile.documents(tokenfile.read(spark, folder)).orderBy("start").collect()
        assert len(rows) == df.count()
        assert [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda x: (x is not None, x or 0))
        assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])


def check_packed(rows, ids_of, size):
    """Every id in one piece, sequences without gaps, crc right; returns the share of padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        fill = sum(r.length for r in own)
        assert fill <= size
        total += fill
        padding += 0 if packing.power_of_two(fill) else size - fill
    for doc, own in pieces.items():
        ids = ids_of[doc]
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return padding / max(total, 1)


def test_op8(spark, sf, texts):
    lib = plain_library()
    ids = {d: lib.encode(t, add_special_tokens=False).ids + [2] for d, t in texts.items()}
    rows = queries.op8_packing(spark, sf).collect()
    assert {r.doc_id for r in rows} == ids.keys()
    assert check_packed(rows, ids, 4096) < 0.02


def test_packing_one_common_length(spark):
    texts = {i: "a b c d e f g h i j k l m n o p q r s t u v w" for i in range(300)} | {1000 + i: "x " * (i % 50) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    lib = plain_library()
    ids = {d: lib.encode(t, add_special_tokens=False).ids + [2] for d, t in texts.items()}
    rows = packing.packed(df, WORDS, size=64, grid=8).collect()
    assert check_packed(rows, ids, 64) < 0.1


def test_packing_odd_rows(odd, none):
    rows = packing.packed(odd, WORDS).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.doc_id is None) > 1
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    assert packing.packed(none, WORDS).count() == 0


def test_plan_uses_the_whole_histogram():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = np.zeros(129, dtype=np.int64)
        counts[1:] = rng.integers(0, 50, 128) * (rng.random(128) < 0.4)
        used = np.zeros_like(counts)
        for lengths, n in packing.planned(counts, 128):
            assert 0 < sum(lengths) <= 128 and n > 0
            for p in lengths:
                used[p] += n
        assert (used == counts).all()
