"""Packing documents into sequences by non-negative least squares over length combinations.

Every document is cut into full sequences and a remainder. The histogram of lengths (one number for each of
``size`` lengths, whatever the corpus) is all that reaches the driver, where the plan is made:

1. Combinations of two or three lengths that fill a sequence are enumerated: all pairs, and triples with one of
   the ``FREQUENT`` commonest lengths. Non-negative least squares gives the repeat counts that use the
   histogram best; they are rounded down.
2. What is left is packed greedily, largest first, each gap with the largest length that fits.
3. Sequences that would still be padded by more than the share ``MAX_PAD`` are given up. Their remainders of at least
   ``GRID`` ids are cut after the largest power of two, and the parts are packed by 1 and 2 again.

A plan says for each length which ranks go where. Ranks are counted per length and input split, and offsets per
(length, split) are running sums, so no length, however common, is numbered in one task.

Null text counts as empty: such a document is its end id. Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from molaris.llm.common import written
from molaris.llm.wordbpe import TOGETHER, loaded

SIZE = 4096
END = 2
FREQUENT = 12
MAX_PAD = 0.012
#: Remainders of at least this length, a power of two, can be cut.
GRID = 512
STEPS = 400


# lengths


def combinations(counts: np.ndarray, size: int, frequent: int = FREQUENT) -> np.ndarray:
    """Rows of three lengths (0 for none) that add up to the size and stand in the histogram."""
    there = np.flatnonzero(counts)
    there = there[(there > 0) & (there < size)]
    has = np.zeros(size + 1, dtype=bool)
    has[there] = True
    pairs = there[(there <= size - there) & has[size - there]]
    rows = [np.stack([pairs, size - pairs, np.zeros_like(pairs)], axis=1)]
    for common in there[np.argsort(-counts[there], kind="stable")][:frequent]:
        rest = size - common
        b = there[there <= rest - there]
        b = b[has[rest - b]]
        rows.append(np.stack([np.full_like(b, common), rest - b, b], axis=1))
    found = np.sort(np.concatenate(rows), axis=1)[:, ::-1]
    return np.unique(found, axis=0)


def repeats(parts: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x with ``uses x`` nearest to the histogram, by accelerated projected gradient."""
    target = counts.astype(float).copy()
    target[0] = 0
    weight = 1 / np.maximum(target, 1)  # every length counts alike
    x = np.zeros(len(parts))
    ahead, t = x.copy(), 1.0

    def used(v):
        out = np.bincount(parts.ravel(), np.repeat(v, 3), len(counts))
        out[0] = 0
        return out

    degree = used(np.ones(len(parts)))
    # the largest row sum of the weighted normal matrix bounds its norm
    scale = 1 / np.maximum(sum(np.where(parts[:, c] > 0, weight[parts[:, c]] * degree[parts[:, c]], 0) for c in range(3)) * 3, 1e-12)
    for _ in range(steps):
        miss = (used(ahead) - target) * weight
        slope = sum(np.where(parts[:, c] > 0, miss[parts[:, c]], 0) for c in range(3))
        new = np.maximum(ahead - scale * slope, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / later * (new - x), new, later
    return x


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def planned(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many of them) that use the whole histogram."""
    left = counts.copy()
    out = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    parts = combinations(left, size)
    if len(parts):
        wished = np.floor(repeats(parts, left)).astype(np.int64)
        for row in np.argsort(-wished, kind="stable"):
            if not wished[row]:
                break
            need = Counter(int(p) for p in parts[row] if p)
            n = min(int(wished[row]), *(int(left[p]) // k for p, k in need.items()))
            if n:
                out.append((tuple(sorted(need.elements(), reverse=True)), n))
                for p, k in need.items():
                    left[p] -= n * k
    lengths = np.flatnonzero(left)
    while len(lengths):
        need, space = Counter(), size
        while True:
            at = int(np.searchsorted(lengths, space, side="right")) - 1
            while at >= 0 and left[lengths[at]] <= need[int(lengths[at])]:
                at -= 1
            if at < 0:
                break
            p = int(lengths[at])
            k = max(1, min(space // p, int(left[p]) - need[p]))
            need[p] += k
            space -= k * p
        n = min(int(left[p]) // k for p, k in need.items())
        out.append((tuple(sorted(need.elements(), reverse=True)), n))
        for p, k in need.items():
            left[p] -= n * k
        lengths = lengths[left[lengths] > 0]
    return out


@dataclass
class Placed:
    """Where the ranks of one length go: from ``start`` on, ``uses`` of them to each sequence from ``sequence``."""

    starts: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)  # -1: cut
    offsets: list[tuple[int, ...]] = field(default_factory=list)
    cut: list[tuple[int, int, int] | None] = field(default_factory=list)  # cut point, first rank of the parts


@dataclass
class Plan:
    """Places of whole remainders and, of those that are cut, of their parts."""

    whole: dict[int, Placed]
    parts: dict[int, Placed]
    sequences: int


def _place(out: dict[int, Placed], ranks: Counter, lengths: tuple[int, ...], n: int, sequence: int) -> None:
    at, of = 0, {}
    for p in lengths:
        of.setdefault(p, []).append(at)
        at += p
    for p, offsets in of.items():
        placed = out.setdefault(p, Placed())
        placed.starts.append(ranks[p])
        placed.sequence.append(sequence)
        placed.offsets.append(tuple(offsets))
        placed.cut.append(None)
        ranks[p] += n * len(offsets)


def plan(counts: np.ndarray, size: int = SIZE, grid: int = GRID, max_pad: float = MAX_PAD) -> Plan:
    whole, ranks, sequence = {}, Counter(), 0
    parts, part_counts = {}, np.zeros(size + 1, dtype=np.int64)
    for lengths, n in planned(counts, size):
        fill = sum(lengths)
        if size - fill <= max_pad * size or power_of_two(fill):
            _place(whole, ranks, lengths, n, sequence)
            sequence += n
            continue
        for p, k in Counter(lengths).items():
            # a cut after all ids leaves one part
            cut = 1 << p.bit_length() - 1 if p >= grid else p
            placed = whole.setdefault(p, Placed())
            placed.starts.append(ranks[p])
            placed.sequence.append(-1)
            placed.offsets.append(())
            placed.cut.append((cut, int(part_counts[cut]), int(part_counts[p - cut]) if p > cut else 0))
            ranks[p] += n * k
            part_counts[cut] += n * k
            if p > cut:
                part_counts[p - cut] += n * k
    ranks = Counter()
    for lengths, n in planned(part_counts, size):
        _place(parts, ranks, lengths, n, sequence)
        sequence += n
    return Plan(whole, parts, sequence)


# documents


def _pieces(path: str, size: int, grid: int, end: int):
    def crc(x: np.ndarray) -> int:
        return zlib.crc32(x.astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = loaded(path), TaskContext.get().partitionId()
        seen: Counter = Counter()
        powers = [1 << b for b in range(grid.bit_length() - 1, size.bit_length())]
        last = np.array([end], np.uint32)
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = []
            for at in range(0, len(names), TOGETHER):
                texts = [t or "" for t in batch.column(1).slice(at, TOGETHER).to_pylist()]
                for name, x in zip(names[at:at + TOGETHER], words.encode(texts)):
                    x = np.concatenate([x, last])
                    for start in range(0, len(x), size):
                        part = x[start:start + size]
                        cuts = [c for c in powers if c < len(part) < size]
                        rows.append((
                            name, start, len(part), crc(part), len(x), split, seen[len(part)],
                            [crc(part[:c]) for c in cuts], [crc(part[c:]) for c in cuts],
                        ))
                        seen[len(part)] += 1
            kinds = [pa.int64()] * 4 + [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "split", "nth", "before", "after"])

    return run


_PIECE = """doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, split int, nth bigint,
    before array<bigint>, after array<bigint>"""
_PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _put(length: np.ndarray, rank: np.ndarray, of: dict[int, Placed]) -> tuple[np.ndarray, ...]:
    """Sequence (-1: cut) and offset of pieces, and the cut point and the ranks of the two parts."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    cut, first, second = (np.zeros(len(length), np.int64) for _ in range(3))
    order = np.argsort(length, kind="stable")
    bounds = np.flatnonzero(np.diff(length[order])) + 1
    for rows in np.split(order, bounds) if len(order) else []:
        placed = of[int(length[rows[0]])]
        starts = np.array(placed.starts)
        segment = np.searchsorted(starts, rank[rows], side="right") - 1
        for s in np.unique(segment):
            mine = rows[segment == s]
            inside = rank[mine] - starts[s]
            if placed.sequence[s] < 0:
                sequence[mine] = -1
                cut[mine], a, b = placed.cut[s]
                first[mine], second[mine] = a + inside, b + inside
            else:
                offsets = np.array(placed.offsets[s])
                sequence[mine] = placed.sequence[s] + inside // len(offsets)
                offset[mine] = offsets[inside % len(offsets)]
    return sequence, offset, cut, first, second


def _packed(made: Plan, grid: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset, cut, first, second = _put(length, rank, made.whole)
            columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "none"]
            keep = sequence >= 0
            yield batch.loc[keep, columns].assign(sequence_id=sequence[keep], offset=offset[keep])
            gone = np.flatnonzero(~keep)
            if not len(gone):
                continue
            rows, at = batch.iloc[gone], cut[gone]
            uncut = at == length[gone]
            k = np.where(uncut, 0, np.log2(np.maximum(at, 1)).astype(int) - (grid.bit_length() - 1))
            for part in (0, 1):
                own = np.ones(len(gone), bool) if part == 0 else ~uncut
                if not own.any():
                    continue
                some = rows[own]
                n = at[own] if part == 0 else (length[gone] - at)[own]
                crcs = [
                    whole if flat else (before if part == 0 else after)[i]
                    for whole, flat, before, after, i in zip(some["ids_crc32"], uncut[own], some["before"], some["after"], k[own])
                ]
                s, o, *_ = _put(n, (first if part == 0 else second)[gone][own], made.parts)
                yield some[columns].assign(
                    start=some["start"] + (0 if part == 0 else at[own]), length=n, ids_crc32=np.array(crcs, dtype=np.int64),
                    sequence_id=s, offset=o)

    return run


def packed(
    df: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, end: int = END, grid: int = GRID,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece and its place."""
    rows = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = written(rows.mapInArrow(_pieces(vocabulary, size, grid, end), _PIECE), "pieces")
    by_split = written(pieces.groupBy("length", "split").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in by_split.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        counts[r["length"]] = r["n"]
    made = plan(counts, size, grid)
    before = W.partitionBy("length").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_split.select("length", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(offsets, ["length", "split"]).withColumn("rank", F.col("first") + F.col("nth"))
    # pandas has no null in whole numbers
    ranked = ranked.withColumn("none", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    placed = ranked.mapInPandas(_packed(made, grid), _PACKED + ", none boolean")
    return placed.withColumn("doc_id", F.expr("CASE WHEN NOT none THEN doc_id END")).drop("none")
