"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments (22, 21 and 21 bits, each padded to the 23 of the perfect
binary Golay code). The indices of all codewords within distance 4 of a segment, one or six of them, are its
fuzzy hashes: if two words differ in at most two bits, the word halfway is within 3 of one codeword, so this
codeword is within 4 of both. At most four differing bits fall on three segments in one of two ways:

* one segment is equal and another has at most two: keys (equal segment, codeword of the other), six ways;
* no segment is equal, so none has more than two: keys of three codewords.

So every link shares a key. Equal fingerprints are one row before keys are made. Rows meet by key in sorted
partitions; inside the run of one key a search from linked to unlinked fingerprints verifies bit distances
and emits a spanning forest of the run's links, not its pairs. Links give connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molaris.llm.common import packed_row, written
from molaris.llm.components import connected

SHINGLE = 4
SEED = 42
MAX_BITS = 4

#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))

_HASHES_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 22


# fingerprints


def shingle_hashes(text: str, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, in blocks. Words are lower-cased in A-Z only."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    del words
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _HASHES_AT_ONCE):
        spans = zip(starts[at:at + _HASHES_AT_ONCE].tolist(), ends[at:at + _HASHES_AT_ONCE].tolist())
        yield np.array([digest(line[a:b], seed) for a, b in spans], dtype="<u8")


def fingerprint_of(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if more than half of the hashes have it; 0 without words."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for block in shingle_hashes(text, size, seed):
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # at most 255 ones fit a byte
            ones += bits[part:part + 255].sum(axis=0, dtype=np.uint8)
        total += len(block)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int = SHINGLE, seed: int = SEED) -> Column:
    """Fingerprint as long; a null text counts as empty."""

    @F.arrow_udf("bigint")
    def make(batch: pa.Array) -> pa.Array:
        prints = np.array([fingerprint_of(x.as_py() or "", size, seed) for x in batch], dtype=np.uint64)
        return pa.array(prints.view(np.int64))

    return make(text)


# keys


@lru_cache(1)
def near_codewords() -> np.ndarray:
    """For each syndrome, up to six patterns that lead to the codewords within distance 4; -1 fills up."""
    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [syndrome(1 << bit) for bit in range(23)]
    found: list[list[int]] = [[] for _ in range(1 << 11)]

    def grow(pattern: int, code: int, start: int, left: int) -> None:
        found[code].append(pattern)
        if left:
            for bit in range(start, 23):
                grow(pattern | 1 << bit, code ^ single[bit], bit + 1, left - 1)

    grow(0, 0, 0, 4)
    return np.array([x + [-1] * (6 - len(x)) for x in found], dtype=np.int64)


@lru_cache(1)
def _syndromes() -> np.ndarray:
    """Syndrome of the 2^12 upper parts; the lower 11 bits of a word are added to it."""
    words = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


def fuzzy_hashes(segment: np.ndarray) -> np.ndarray:
    """Six columns of codeword indices (12 bits) for words of 23 bits; -1 where there is none."""
    patterns = near_codewords()[_syndromes()[segment >> 11] ^ (segment & 0x7FF)]
    return np.where(patterns < 0, -1, (segment[:, None] ^ patterns) >> 11)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every key of every fingerprint."""
    whole = prints.view(np.uint64)
    exact = [((whole >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    fuzzy = [fuzzy_hashes(x) for x in exact]
    n = len(prints)
    blocks = []
    kind = 0
    for a in range(3):
        for b in range(3):
            if a != b:
                # the kind, the equal segment and the codeword index stand side by side
                key = (kind << 40) | (exact[a][:, None] << 12) | fuzzy[b]
                blocks.append(np.where(fuzzy[b] < 0, -1, key))
                kind += 1
    x, y, z = fuzzy[0][:, :, None, None], fuzzy[1][:, None, :, None], fuzzy[2][:, None, None, :]
    triple = (kind << 40) | (x << 24) | (y << 12) | z
    blocks.append(np.where((x < 0) | (y < 0) | (z < 0), -1, triple).reshape(n, -1))
    keys = np.concatenate(blocks, axis=1)
    row, column = np.nonzero(keys >= 0)
    return row, keys[row, column]


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 1024):
            part = prints[at:at + 1024]
            row, key = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


# links


def forest(run: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links within one run of distinct fingerprints."""
    rest, froms, tos = run, [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, _PAIRS_AT_ONCE // len(rest))
            part, front = front[:step], front[step:]
            near = np.bitwise_count(part[:, None] ^ rest[None, :]) <= max_bits
            hit = near.any(axis=0)
            if hit.any():
                froms.append(part[near[:, hit].argmax(axis=0)])
                tos.append(rest[hit])
                front = np.concatenate([front, rest[hit]])
                rest = rest[~hit]
    return froms, tos


def _links(max_bits: int):
    def links_of(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        first = starts[sizes == 2]
        close = np.bitwise_count(fp[first] ^ fp[first + 1]) <= max_bits
        froms, tos = [fp[first[close]]], [fp[first[close] + 1]]
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            a, b = forest(np.unique(fp[at:at + size]), max_bits)
            froms += a
            tos += b
        pairs = np.unique(np.stack([np.concatenate(froms), np.concatenate(tos)], axis=1), axis=0)
        a, b = pairs.min(axis=1).view(np.int64), pairs.max(axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key; the last run of a batch may go on in the next."""
        held_key, held = [], []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            if held_key and key[-1] == held_key[-1][-1]:
                held_key.append(key)
                held.append(fp)
                continue
            last = int(np.searchsorted(key, key[-1]))
            keys, prints = np.concatenate([*held_key, key[:last]]), np.concatenate([*held, fp[:last]])
            held_key, held = [key[last:]], [fp[last:]]
            if len(keys):
                yield links_of(keys, prints)
        if held_key:
            yield links_of(np.concatenate(held_key), np.concatenate(held))

    return run


def linked(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between the distinct values of the one long column ``fp`` that keep every component whole."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys reach links of at most {MAX_BITS} bits")
    keys = prints.select("fp").mapInArrow(_key_rows, "key bigint, fp bigint")
    met = keys.repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(_links(max_bits), "a bigint, b bigint").distinct()


def components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id, root) from rows (doc_id, fp): the smallest doc_id that a fingerprint's links reach, and a
    fingerprint that stands for the component."""
    first = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "prints")
    root = connected(linked(first, max_bits), "a", "b").select(F.col("node").alias("fp"), "root")
    # few fingerprints have links; the others are alone
    placed = written(first.join(root, "fp"), "rooted")
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_linked = placed.join(smallest, "root").select("fp", "component_id", "root")
    return first.join(of_linked, "fp", "left").select(
        "fp", F.expr("CASE WHEN root IS NULL THEN doc_id ELSE component_id END").alias("component_id"),
        F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(doc_id, fp, component_id, root) of every row; the texts themselves are not moved.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay; they share
    a component. A component all of whose ids are null has the id null.
    """
    rows = written(df.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), fingerprint(F.col(f"`{text}`"), shingle, seed).alias("fp")), "fingerprints")
    return rows.join(components(rows, max_bits), "fp").select("doc_id", "fp", "component_id", "root")


def one_of_each(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """The rows of the smallest id of every component, one for each of its texts.

    Of a component all of whose ids are null, the row of one fingerprint with the smallest text stays. Of rows equal in id
    and text the one with the smallest hash of all its columns stays, whatever order they come in.
    """
    found = written(near_duplicates(df, text, doc_id, shingle, seed, max_bits), "components")
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_s_doc")).distinct()
    hashed = ", ".join(f"`{c}`" for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind)
    # the row is kept in one column, so no name of its own can clash
    rows = df.select(packed_row(df), F.col(f"`{doc_id}`").cast("bigint").alias("_s_id"), F.expr(f"coalesce(`{text}`, '')").alias("_s_text"),
                     F.expr(f"struct(xxhash64({hashed}) AS a, xxhash64('2', {hashed}) AS b)").alias("_s_hash"))
    named = rows.join(keep, F.col("_s_id") == F.col("_s_doc"), "left_semi").groupBy(
        "_s_id", F.expr(f"xxhash64(_row.`{text}`)").alias("_s_t1"), F.expr(f"xxhash64('2', _row.`{text}`)").alias("_s_t2"),
    ).agg(F.min_by("_row", "_s_hash").alias("_row"))
    alone = found.filter("component_id IS NULL").groupBy("root").agg(F.min("fp").alias("_s_fp"))
    nameless = rows.filter("_s_id IS NULL").withColumn("_s_own", fingerprint(F.col(f"_row.`{text}`"), shingle, seed))
    # equal fingerprints of null ids may be different texts: the smallest text
    rest = nameless.join(alone, F.col("_s_own") == F.col("_s_fp")).groupBy("_s_fp").agg(
        F.min_by("_row", F.struct("_s_text", "_s_hash")).alias("_row"))
    return named.select("_row.*").unionByName(rest.select("_row.*"))
