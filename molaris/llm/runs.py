"""Periodic runs of words: suffix trees, constant-time common extensions, Lyndon roots.

A run is a stretch of words with smallest period q, at least ``MINIMUM`` words and two periods long, that no
neighbouring word extends keeping the period.

Method. Ukkonen's algorithm builds the suffix trees of the word numbers and of their reversal. The longest common
extension of two places is the depth of the lowest common ancestor of two leaves: a range minimum over the Euler tour,
in constant time. The longest Lyndon word that starts at a place ends where the next smaller suffix starts; taken for
the order of words and for its opposite, these words hold a root of every run. Each is extended to both sides.

Only stretches that can hold a run go into a tree. Two copies of a window of ``WINDOW`` words, a period apart, start
at every place of the first part of a run, and their windows cover it whole; so words that no repeated window covers
lie in no run, and a run lies in one covered stretch. The test is by hash; equal hashes of different windows only make
a stretch longer. Stretches, divided by numbers of their own, share a tree until it has ``TOGETHER`` words.

A document is one piece of work: about 1 KB of memory for each word in its longest covered stretch.

* Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have none: no runs, an empty collapsed text.
* Each row is judged by itself, so repeated rows, null ids and other columns change nothing; all columns stay.
* Runs come by start, then period. Several runs may overlap; no two have start and length in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molaris.llm.common import free_name

MINIMUM = 12
WINDOW = 6
TOGETHER = 16_384
BLOCK = 16
RESULT = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, ends, periods


class SuffixTree:
    """Ukkonen's tree of a sequence whose last symbol occurs once, with its Euler tour."""

    def __init__(self, symbols: list[int]) -> None:
        self.size = len(symbols)
        self._build(symbols)
        self._walk()

    def _build(self, symbols: list[int]) -> None:
        size = self.size
        # per node: its edge is symbols[start:stop]; leaves have no kids but the place of their suffix
        start, stop, link, kids, suffix = [0], [0], [0], [{}], [0]
        node = edge = length = waiting = 0
        for i, symbol in enumerate(symbols):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                below = kids[node]
                child = below.get(symbols[edge])
                if child is None:
                    below[symbols[edge]] = len(start)
                    owner = node
                else:
                    first = start[child]
                    along = min(stop[child], i + 1) - first
                    if length >= along:
                        node, edge, length = child, edge + along, length - along
                        continue
                    if symbols[first + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    owner = len(start)
                    below[symbols[edge]] = owner
                    start.append(first)
                    stop.append(first + length)
                    link.append(0)
                    kids.append({symbols[first + length]: child, symbol: owner + 1})
                    suffix.append(0)
                    start[child] = first + length
                if unlinked:
                    link[unlinked] = owner
                unlinked = owner if child is not None else 0
                start.append(i)
                stop.append(size)
                link.append(0)
                kids.append(None)
                suffix.append(i - waiting + 1)
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._nodes = start, stop, kids, suffix

    def _walk(self) -> None:
        """The Euler tour as depths in symbols, where each leaf stands in it, and the rank of each suffix."""
        start, stop, kids, suffix = self._nodes
        del self._nodes
        size = self.size
        tour, place, rank, seen = [0], [0] * size, [0] * size, 0
        path = [(iter(sorted(kids[0].items())), 0)]
        while path:
            children, depth = path[-1]
            for _, child in children:
                below = kids[child]
                if below is None:
                    at = suffix[child]
                    place[at], rank[at] = len(tour), seen
                    seen += 1
                    tour += (size - at, depth)
                else:
                    deeper = depth + stop[child] - start[child]
                    tour.append(deeper)
                    path.append((iter(sorted(below.items())), deeper))
                    break
            else:
                path.pop()
                if path:
                    tour.append(path[-1][1])
        self.rank = rank
        self._place = np.array(place)
        self._depth = RangeMinimum(np.array(tour, dtype=np.int32))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from two different places on are the same, for arrays of places."""
        x, y = self._place[a], self._place[b]
        return self._depth.least(np.minimum(x, y), np.maximum(x, y))


class RangeMinimum:
    """Least values of ranges in constant time: minima to both ends of a block, doubled ranges of whole blocks."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.pad(values, (0, -len(values) % BLOCK), constant_values=np.iinfo(values.dtype).max)
        rows = self.values.reshape(-1, BLOCK)
        self.up_to = np.minimum.accumulate(rows, axis=1).ravel()
        self.after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= len(rows):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low:high + 1]."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.after[low], self.up_to[high])
        same = np.flatnonzero(a == b)
        if len(same):
            found, end = self.values[low[same]].copy(), high[same]
            for k in range(1, BLOCK):
                at = np.minimum(low[same] + k, end)
                np.minimum(found, self.values[at], out=found)
            out[same] = found
        between = b - a - 1
        for level, values in enumerate(self.levels):
            at = np.flatnonzero((between >= 1 << level) & (between < 2 << level))
            if len(at):
                found = np.minimum(values[a[at] + 1], values[b[at] - (1 << level)])
                out[at] = np.minimum(out[at], found)
        return out


def next_smaller(values: list[int]) -> list[int]:
    """The next place with a smaller value; the length where there is none."""
    out, open_ = [len(values)] * len(values), []
    for i, value in enumerate(values):
        while open_ and values[open_[-1]] > value:
            out[open_.pop()] = i
        open_.append(i)
    return out


def all_runs(symbols: np.ndarray, minimum: int = 2) -> Runs:
    """Every run of at least ``minimum`` symbols of a sequence of positive numbers, by start and period."""
    size = len(symbols)
    forward = SuffixTree([*symbols.tolist(), 0])
    starts = np.arange(size)
    # a Lyndon word under the order, and one under its opposite, for each place
    ends = [np.array(next_smaller(forward.rank)[:size], dtype=np.int64),
            np.array(next_smaller([-r for r in forward.rank])[:size], dtype=np.int64)]
    first, second = np.concatenate([starts, starts]), np.concatenate(ends)
    inside = second < size
    first, second = first[inside], second[inside]
    right = forward.extension(first, second)
    del forward
    backward = SuffixTree([*symbols[::-1].tolist(), 0])
    left = backward.extension(size - first, size - second)
    period = second - first
    start, end = first - left, second + right
    good = end - start >= np.maximum(2 * period, minimum)
    if not good.any():
        return (np.zeros(0, np.int64),) * 3
    found = np.unique(np.stack([start[good], period[good], end[good]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def covered_stretches(words: np.ndarray, document: np.ndarray, minimum: int = MINIMUM) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that repeated windows cover, windows repeated in the same stretch."""
    window = min(WINDOW, minimum // 2)
    places = np.arange(max(len(words) - window + 1, 0))
    if not len(places):
        return places, places
    places = places[document[places] == document[places + window - 1]]
    mixed = np.zeros(len(places), dtype=np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[places + k].astype(np.uint64) + np.uint64(1)
    group = document[places]
    while True:
        key = (mixed ^ (mixed >> np.uint64(29))) + group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        again = pd.Series(key).duplicated(keep=False).to_numpy()
        places, mixed = places[again], mixed[again]
        depth = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(depth, places, 1)
        np.add.at(depth, places + window, -1)
        held = np.cumsum(depth[:-1]) > 0
        new = np.ones(len(words), dtype=bool)
        new[1:] = (document[1:] != document[:-1]) | ~held[:-1]
        starts = np.flatnonzero(held & new)
        last = np.ones(len(words), dtype=bool)
        last[:-1] = new[1:] | ~held[1:]
        ends = np.flatnonzero(held & last) + 1
        group = np.searchsorted(starts, places, side="right")
        long = ends - starts >= minimum
        stays = long[group - 1] if len(places) else np.zeros(0, dtype=bool)
        if again.all() and stays.all():
            return starts[long], ends[long]
        places, mixed, group = places[stays], mixed[stays], group[stays]


def runs_of(words: np.ndarray, document: np.ndarray, minimum: int = MINIMUM) -> Runs:
    """The runs of many documents that lie one after the other; places count over all of them."""
    starts, ends = covered_stretches(words, document, minimum)
    sizes, found, at = ends - starts + 1, [], 0
    while at < len(starts):
        # as many stretches as fit, one at least
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), TOGETHER, side="right")) + at)
        parts, origins, divider = [], [], int(words.max()) + 2
        for k in range(at, upto):
            parts += [words[starts[k]:ends[k]] + 1, [divider + k - at]]
            origins.append(np.arange(starts[k], ends[k] + 1))
        origin = np.concatenate(origins)
        a, b, period = all_runs(np.concatenate(parts).astype(np.int64), minimum)
        found.append((origin[a], origin[b - 1] + 1, period))
        at = upto
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _batch(raws: list[bytes | None], minimum: int) -> pa.Array:
    lists = [(raw or b"").split() for raw in raws]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    numbers = pa.array(chain.from_iterable(lists), pa.binary(), size=int(bounds[-1])).dictionary_encode().indices
    document = np.repeat(np.arange(len(lists)), sizes)
    start, end, period = runs_of(numbers.to_numpy(zero_copy_only=False).astype(np.int64), document, minimum)
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    runs: list[list[dict]] = [[] for _ in lists]
    gone = np.zeros(int(bounds[-1]) + 1, dtype=np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    stays = np.cumsum(gone[:-1]) == 0
    owner = document[start] if len(start) else start
    for doc, a, b, q in zip(owner.tolist(), start.tolist(), end.tolist(), period.tolist()):
        runs[doc].append({"start": a - int(bounds[doc]), "length": b - a, "period": q})
    collapsed = [
        b" ".join(compress(own, stays[bounds[i]:bounds[i + 1]].tolist()) if runs[i] else own) for i, own in enumerate(lists)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.StructArray.from_arrays(
        [pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], ["runs", "collapsed"])


def periodic(text: Column, minimum: int = MINIMUM) -> Column:
    """The runs of a text and the text without what repeats: a run's words after its first period go."""

    @F.arrow_udf(RESULT)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _batch(batch.cast(pa.binary()).to_pylist(), minimum)

    return find(text)


def found(df: DataFrame, text: str = "text", minimum: int = MINIMUM) -> tuple[DataFrame, str]:
    """The table with one more struct column (its name is the second result): runs, collapsed."""
    out = free_name(df, "periodic")
    return df.withColumn(out, periodic(F.col(f"`{text}`"), minimum)), out
