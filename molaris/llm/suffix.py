"""Removal of repeated byte strings with suffix arrays.

Removed is every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

Sorting all suffixes of a corpus would ship every position with its bytes. So shards are made of what can repeat:

1. Winnowing. Among the q-grams of each string of LENGTH bytes the one with the smallest hash is its anchor, which
   equal strings share. A run of neighbouring strings with one anchor is its context, at most
   ``2 * LENGTH - Q`` bytes. Contexts are dealt by anchor hash, as packed columns, copies within a task once.
   Of equal contexts all but those of the smallest document go whole. Different contexts of one anchor can share a
   string only if its 16 bytes before or its 16 bytes after the anchor are equal in two documents, as at least
   ``LENGTH - Q`` bytes must be equal besides the anchor; hashes of both tell. Such contexts remain.
2. Suffix arrays. These contexts, each distinct one once, are laid out in shards of ``SHARD`` bytes in order of
   (anchor, document). A shard's suffixes are sorted by Larsson-Sadakane refinement (8 bytes first, then
   doubling, groups of one left alone), Kasai's recurrence gives common prefixes, and neighbours that share
   LENGTH bytes form classes; starts in other than a class's smallest document go. An anchor whose contexts
   go on in the next shard leaves its sorted strings, and the next shard looks its own up by binary search.
3. An anchor with more than ``CROWD`` different contexts (the edge of a passage that a great part of the corpus
   shares) would be one long chain of shards. Its strings are dealt by their own hash instead, as in 1.

Every span carries a hash of the bytes it was found in, and is only used where these stand: ids may repeat.

* Null text counts as empty. Null ids count as the largest id. Rows of one id are never each other's source.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molaris.llm.common import free_name, packed_row, written

LENGTH = 50
Q = 16
SHARD = 1 << 20
CROWD = 4096
#: Bytes of text whose anchors are compared together, of these bytes laid out at once (a byte takes about 60 of memory while
#: its anchor is found), anchors that are dealt at once, and text per bucket of anchors.
TOGETHER = 1 << 22
SLICE = 1 << 19
ANCHORS = 1 << 20
BUCKET_TEXT = 1 << 22

NULL_ID = (1 << 63) - 1
#: Never a byte of UTF-8 text.
_GAP = 0xFF
_POSITION = 24


# anchors


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number."""
    raw, n = data.tobytes(), len(data) - 7
    out = np.empty(n, dtype=np.uint64)
    for k in range(8):
        out[k::8] = np.frombuffer(raw, "<u8", len(range(k, n, 8)), k)
    return out


def q_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the Q bytes from each position on."""
    w = _words(data)
    h = w[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (w[8:] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(data: bytes, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, start in it, number of starts, anchor hash, hash before, hash after) of every context of the texts laid
    out in data, which holds fewer than 2^24 bytes, and at least 32 more than the texts.

    The hashes of the Q bytes before and after the anchor have 16 bits, and are 0 where a text has fewer bytes.
    """
    hashes = q_hashes(np.frombuffer(data, np.uint8))
    at = np.arange(len(hashes), dtype=np.uint64)
    low = sliding_min((hashes >> np.uint64(_POSITION) << np.uint64(_POSITION)) | at, length - Q + 1)
    fits = np.flatnonzero(sizes >= length)
    n = sizes[fits] - length + 1
    text = np.repeat(fits, n)
    begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    chosen = low[np.repeat(starts[fits], n) + begin]
    new = np.ones(len(chosen), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(chosen)))
    text, chosen = text[head], chosen[head]
    place = (chosen & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    sides = []
    for side, whole in ((place - Q, place - Q >= starts[text]), (place + Q, place + 2 * Q <= starts[text] + sizes[text])):
        some = hashes[np.where(whole, side, 0)] >> np.uint64(48)
        sides.append(np.where(whole, np.maximum(some, 1), 0).astype(np.uint16))
    return text, begin[head], count, chosen >> np.uint64(_POSITION), *sides


def digest(data) -> int:
    return xxhash.xxh3_64_intdigest(data)


# packed columns

_COLUMNS = (("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("n", "u1"), ("before", "<u2"), ("after", "<u2"))


def packed(columns: list[np.ndarray], press) -> bytes:
    """Columns of the same length, in order of (doc, at); differences press better."""
    order = np.lexsort((columns[3], columns[2]))
    body = []
    for c, (name, kind) in zip(columns, _COLUMNS):
        c = np.diff(c[order], prepend=0) if name in ("doc", "at") else c[order]
        body.append(_planes(c.astype(kind)))
    return struct.pack("<Q", len(order)) + press.compress(b"".join(body))


def _planes(column: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, and so on."""
    return column.view(np.uint8).reshape(len(column), -1).T.tobytes()


def unpacked(blob: bytes, press) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", blob)
    body, at, out = np.frombuffer(press.decompress(blob[8:]), np.uint8), 0, []
    for name, kind in _COLUMNS:
        width = np.dtype(kind).itemsize
        column = np.ascontiguousarray(body[at:at + size * width].reshape(width, size).T).view(kind).ravel()
        at += size * width
        out.append(np.cumsum(column) if name in ("doc", "at") else column)
    return out


def _dealt(columns: list[np.ndarray], buckets: int, press) -> pa.RecordBatch:
    """One row per bucket with the packed columns of its anchors."""
    bucket = (columns[0] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    names, head = np.unique(bucket[order], return_index=True)
    blobs = [packed([c[rows] for c in columns], press) for rows in np.split(order, head[1:])] if len(order) else []
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _groups(*sorted_columns: np.ndarray) -> np.ndarray:
    """Number of the group of equal neighbours."""
    new = np.zeros(len(sorted_columns[0]), dtype=bool)
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _first_copies(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (key, ctx, doc), and whether each stands in the smallest document of its (key, ctx)."""
    key, ctx, doc = columns[:3]
    order = np.lexsort((doc, ctx, key))
    group = _groups(key[order], ctx[order])
    head = np.flatnonzero(np.diff(group, prepend=-1))
    return order, doc[order] == doc[order][head][group]


_SPANS = "doc bigint, at bigint, n int, seen bigint, key bigint, kind int"
#: What a span is: to be removed; contexts for a shard; contexts of a crowded anchor.
GONE, SHARDED, CROWDED = 0, 1, 2


def _span_rows(doc, at, n, seen, key, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), pa.array(seen.view(np.int64), pa.int64()),
        pa.array(key.view(np.int64), pa.int64()), pa.array(kind, pa.int32())], names=["doc", "at", "n", "seen", "key", "kind"])


def _slices(parts: list[tuple[int, int, bytes]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """The parts by about SLICE bytes; larger ones are cut like long texts."""
    some, size = [], 0
    for doc, place, text in parts:
        for doc, at, piece in _parts(doc, text, length, SLICE) if len(text) > SLICE else [(doc, 0, text)]:
            if some and size + len(piece) > SLICE:
                yield some
                some, size = [], 0
            some.append((doc, place + at, piece))
            size += len(piece)
    yield some


def _anchor_columns(parts: list[tuple[int, int, bytes]], length: int, repeated: bool) -> list[np.ndarray]:
    """Columns of the anchors of some parts of texts; if ``repeated``, only of those that come several times."""
    laid = []
    for some in _slices(parts, length):
        docs, places, texts = zip(*some)
        data = bytes([_GAP]).join(texts) + bytes([_GAP]) * 40
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        text, at, n, key, before, after = anchors(data, starts, sizes, length)
        laid.append((data, starts[text] + at, np.array(docs, np.int64)[text], np.array(places, np.int64)[text] + at, n, key, before, after))
    key = np.concatenate([found[5] for found in laid])
    take = np.ones(len(key), dtype=bool)
    if repeated:
        order = np.argsort(key, kind="stable")
        alike = np.flatnonzero(key[order][1:] == key[order][:-1])
        take[:] = False
        take[order[alike]] = take[order[alike + 1]] = True
    of, out, first = xxhash.xxh3_64_intdigest, [], 0
    for data, begin, doc, at, n, key, before, after in laid:
        mine = np.flatnonzero(take[first:first + len(key)])
        first += len(key)
        begin, n = begin[mine], n[mine]
        spans = zip(begin.tolist(), (begin + n + length - 1).tolist())
        ctx = np.fromiter((of(data[a:b]) for a, b in spans), np.uint64, len(begin))
        out.append([key[mine], ctx, doc[mine], at[mine], n.astype(np.uint8), before[mine], after[mine]])
    return [np.concatenate(c) for c in zip(*out)]


def _parts(doc: int, text: bytes, length: int, size: int = TOGETHER) -> Iterator[tuple[int, int, bytes]]:
    """(id, place, part) of a long text: parts overlap by length - 1 bytes, so each start stands in one of them."""
    for at in range(0, len(text) - length + 1, size):
        yield doc, at, text[at:at + size + length - 1]


def _together(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Some parts of texts at a time, in the same way each time."""
    some, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            for part in _parts(doc.as_py(), text.as_py(), length):
                if some and size + len(part[2]) > TOGETHER:
                    yield some
                    some, size = [], 0
                some.append(part)
                size += len(part[2]) + 1
    if some:
        yield some


def _screened(buckets: int, length: int):
    """Anchors of a task in buckets, the first copies of those that are worked on together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        held, size = [], 0
        for some in _together(batches, length):
            columns = _anchor_columns(some, length, False)
            order, first = _first_copies(columns)
            held.append([c[order[first]] for c in columns])
            size += len(held[-1][0])
            if size >= ANCHORS:
                yield _dealt([np.concatenate(c) for c in zip(*held)], buckets, press)
                held, size = [], 0
        if held:
            yield _dealt([np.concatenate(c) for c in zip(*held)], buckets, press)

    return run


def _own_copies(length: int):
    """The spans that the copies left out by ``_screened`` lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _together(batches, length):
            columns = _anchor_columns(some, length, True)
            order, first = _first_copies(columns)
            key, ctx, doc, at, n, *_ = (c[order[~first]] for c in columns)
            yield _span_rows(doc, at, n.astype(np.int32), ctx, key, np.full(len(doc), GONE, np.int32))

    return run


def _met(crowd: int):
    """Spans from the anchors of each bucket; rows come sorted by bucket."""

    def solve(blobs: list[bytes], press) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*(unpacked(b, press) for b in blobs))]
        order, first = _first_copies(columns)
        key, ctx, doc, at, n, before, after = (c[order] for c in columns)
        by_key, by_ctx = _groups(key), _groups(key, ctx)
        head = np.flatnonzero(np.diff(by_key, prepend=-1))
        contexts = np.diff(np.append(by_ctx[head], by_ctx[-1] + 1))
        open_ = np.zeros(len(key), dtype=bool)
        # different contexts with a side in common, in several documents
        some = np.flatnonzero(first & (contexts > 1)[by_key])
        for side in (before, after):
            mine = some[side[some] > 0]
            mine = mine[np.lexsort((doc[mine], side[mine], key[mine]))]
            if len(mine):
                group = _groups(key[mine], side[mine])
                top = np.flatnonzero(np.diff(group, prepend=-1))
                last = np.append(top[1:], len(mine)) - 1
                several = (doc[mine[top]] != doc[mine[last]]) & (np.maximum.reduceat(by_ctx[mine], top) != np.minimum.reduceat(by_ctx[mine], top))
                open_[mine] |= several[group]
        kind = np.where(contexts[by_key] > crowd, CROWDED, SHARDED)
        take = ~first | open_
        return _span_rows(doc[take], at[take], n[take].astype(np.int32), ctx[take], key[take],
                          np.where(first, kind, GONE)[take].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        held, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if blobs and bucket != held:
                    yield solve(blobs, press)
                    blobs = []
                held = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield solve(blobs, press)

    return run


# suffix arrays


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions in order of the suffixes that start there; refined as by Larsson and Sadakane."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = _words(padded)[:n].byteswap()
    order = np.argsort(first, kind="stable")
    sorted_first = first[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_first[1:] != sorted_first[:-1]
    head = np.flatnonzero(new)
    sizes = np.diff(np.append(head, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(head, sizes)  # a group is named by its first place
    unsorted = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in groups of several
    done = 8
    while len(unsorted):
        at = order[unsorted]
        beyond = at + done
        following = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        own = rank[at]
        by = np.lexsort((following, own))
        at, own, following = at[by], own[by], following[by]
        order[unsorted] = at
        new = np.ones(len(at), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (following[1:] != following[:-1])
        head = np.flatnonzero(new)
        sizes = np.diff(np.append(head, len(at)))
        rank[at] = np.repeat(unsorted[head], sizes)
        unsorted = unsorted[np.repeat(sizes > 1, sizes)]
        done *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to depth, that each suffix in order shares with the one before.

    Kasai's recurrence (one byte further on, at most one byte less is shared) runs along all pieces of the
    text at once; starts and sizes name the pieces.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.full(depth + 1, 0, np.uint8)])
    shared = np.zeros(n, dtype=np.int64)
    have = np.zeros(len(starts), dtype=np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    for step in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -step, side="left"))  # pieces longer than step
        at = starts[:live] + step
        other = before[at]
        h = np.maximum(have[:live] - 1, 0)
        h[other < 0] = 0
        grow = np.flatnonzero((other >= 0) & (h < depth))
        while len(grow):
            a, b = at[grow] + h[grow], other[grow] + h[grow]
            same = (padded[a] == padded[b]) & (a < n) & (b < n)
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < depth]
        have[:live] = h
        shared[at] = h
    return shared[order]


def _shards(length: int, shard: int):
    """Spans to be removed, from contexts (key, doc, at, n, bytes) in order of (key, doc)."""

    def solve(rows: list[tuple], carried: dict) -> tuple[pa.RecordBatch, dict]:
        keys, docs, ats, ns, raws = zip(*rows)
        data = np.frombuffer(bytes([_GAP]).join(raws) + bytes([_GAP]), np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        starts = np.cumsum(sizes + 1) - sizes - 1
        doc, key = np.array(docs, np.int64), np.array(keys, np.int64)
        order = suffix_array(data)
        shared = common_prefixes(data, order, starts, sizes, length)
        # of the suffixes only the starts of the contexts count
        n = np.array(ns, np.int64)
        owner = np.full(len(data), -1, dtype=np.int64)
        begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        piece = np.repeat(np.arange(len(rows)), n)
        owner[starts[piece] + begin] = piece
        real = owner[order] >= 0
        classes = np.cumsum(shared < length)[real]
        place = order[real]
        of = owner[place]
        classes = _groups(classes)
        head = np.flatnonzero(np.diff(classes, prepend=-1))
        least = np.minimum.reduceat(doc[of], head)
        # merge with the strings of the same anchor in the shards before
        window = np.lib.stride_tricks.sliding_window_view(data, length)
        if carried and carried["key"] == key[0]:
            mine = np.flatnonzero(key[of[head]] == carried["key"])
            strings = np.ascontiguousarray(window[place[head[mine]]]).view(f"S{length}").ravel()
            found = np.minimum(np.searchsorted(carried["strings"], strings), len(carried["strings"]) - 1)
            hit = carried["strings"][found] == strings
            least[mine[hit]] = np.minimum(least[mine[hit]], carried["least"][found[hit]])
        last = np.flatnonzero(key[of[head]] == key[-1])
        strings = np.ascontiguousarray(window[place[head[last]]]).view(f"S{length}").ravel()
        kept = {"key": key[-1], "strings": strings, "least": least[last]}
        if carried and carried["key"] == key[-1]:
            every = np.concatenate([carried["strings"], strings])
            names, inverse = np.unique(every, return_inverse=True)
            low = np.full(len(names), NULL_ID)
            np.minimum.at(low, inverse, np.concatenate([carried["least"], kept["least"]]))
            kept |= {"strings": names, "least": low}
        gone = doc[of] > least[classes]
        at, whose = place[gone] - starts[of[gone]] + np.array(ats, np.int64)[of[gone]], of[gone]
        by = np.lexsort((at, whose))
        at, whose, place = at[by], whose[by], place[gone][by]
        run = np.ones(len(at), dtype=bool)
        run[1:] = (whose[1:] != whose[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(run)
        count = np.diff(np.append(first, len(at)))
        buffer = data.tobytes()
        seen = np.array([digest(buffer[p:p + c + length - 1]) for p, c in zip(place[first].tolist(), count.tolist())], np.uint64)
        out = _span_rows(doc[whose[first]], at[first], count.astype(np.int32), seen, key[whose[first]].view(np.uint64),
                         np.zeros(len(first), np.int32))
        return out, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, carried = [], 0, {}
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                rows.append(row)
                size += len(row[4]) + 1
                if size >= shard:
                    out, carried = solve(rows, carried)
                    yield out
                    rows, size = [], 0
        if rows:
            yield solve(rows, carried)[0]

    return run


def _strings(buckets: int, length: int):
    """The strings of crowded anchors, dealt by their own hash; columns as for anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            _, docs, ats, ns, raws = (c.to_pylist() for c in batch.columns)
            n = np.array(ns, np.int64)
            begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            strings = [raw[k:k + length] for raw, m in zip(raws, ns) for k in range(m)]
            ctx = np.fromiter(map(digest, strings), np.uint64, len(strings))
            key = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
            columns = [key, ctx, np.repeat(np.array(docs, np.int64), n), np.repeat(np.array(ats, np.int64), n) + begin,
                       np.ones(len(strings), np.uint8), *[np.zeros(len(strings), np.uint16)] * 2]
            yield _dealt(columns, buckets, press)

    return run


# tables


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _cut_out(text: Column, spans: Column, length: int) -> Column:
    """The spans that stand in the text as they were seen, with their bytes."""

    @F.arrow_udf("array<struct<key:bigint,at:bigint,n:int,raw:binary,kind:int>>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        at, n, seen = (flat.field(f).to_pylist() for f in ("at", "n", "seen"))
        raws, kept, first, ends = [], [], 0, [0]
        for t, size in zip(texts, sizes.tolist()):
            raw = t.as_py()
            for k in range(first, first + size):
                part = raw[at[k]:at[k] + n[k] + length - 1]
                if _signed(digest(part)) == seen[k]:
                    raws.append(part)
                    kept.append(k)
            first += size
            ends.append(len(kept))
        rows = flat.take(pa.array(kept, pa.int64()))
        columns = [rows.field("key"), rows.field("at"), rows.field("n"), pa.array(raws, pa.binary()), rows.field("kind")]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["key", "at", "n", "raw", "kind"]))

    return cut(text, spans)


def _kept(text: Column, spans: Column, length: int) -> Column:
    """The rest of a text and the removed runs, as (start, end)."""

    @F.arrow_udf("struct<kept:binary,removed:array<struct<start:bigint,end:bigint>>>")
    def keep(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out, k = [], 0
        flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ats, ns, seen = (flat.field(f).to_numpy() for f in ("at", "n", "seen"))
        order = np.lexsort((ats, np.repeat(np.arange(len(sizes)), sizes)))
        ats, ns, seen = ats[order].tolist(), ns[order].tolist(), seen[order].tolist()
        for t, size in zip(texts, sizes.tolist()):
            raw, runs = t.as_py(), []
            for a, n, check in zip(ats[k:k + size], ns[k:k + size], seen[k:k + size]):
                b = a + n + length - 1
                if _signed(digest(raw[a:b])) != check:
                    continue
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            k += size
            at, rest = 0, []
            for a, b in runs:
                rest.append(raw[at:a])
                at = b
            rest.append(raw[at:])
            out.append({"kept": b"".join(rest), "removed": [{"start": a, "end": b} for a, b in runs]})
        run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.array(out, pa.struct([("kept", pa.binary()), ("removed", pa.list_(run))]))

    return keep(text, spans)


def repeats_removed(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> tuple[DataFrame, str]:
    """The table with a struct column added, and its name: kept (bytes) and removed (runs of bytes)."""
    if not 3 * Q - 1 <= length < Q + 128:
        raise ValueError(f"length must lie between {3 * Q - 1} and {Q + 127}")
    out = free_name(df, "repeats")
    # the row is kept in one column, so no name of its own can clash
    raw = df.select(
        packed_row(df), F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NULL_ID)).alias("_s_doc"),
        F.expr(f"CAST(coalesce(`{text}`, '') AS BINARY)").alias("_s_raw"))
    only = raw.select("_s_doc", "_s_raw")
    if "Exchange" in only._jdf.queryExecution().executedPlan().toString():
        # two passes below have to meet the rows in one order, which only a file scan keeps
        only = written(only, "texts")
    total = only.agg(F.sum(F.length("_s_raw"))).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(4 * parts, total // BUCKET_TEXT), 1 << 30)

    def met(dealt: DataFrame) -> DataFrame:
        return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met(CROWD), _SPANS)

    dealt = only.mapInArrow(_screened(buckets, length), "bucket int, blob binary")
    # a task decides on its own copies, so they are not dealt
    alike = only.mapInArrow(_own_copies(length), _SPANS)
    spans = written(met(dealt).unionByName(alike), "spans")

    listed = F.collect_list(F.struct("at", "n", "seen", "key", "kind")).alias("s")
    asked = spans.filter(f"kind <> {GONE}").groupBy("doc").agg(listed)
    found = raw.select("_s_doc", "_s_raw").join(asked, F.col("_s_doc") == F.col("doc"))
    contexts = written(found.select("doc", F.explode(_cut_out(F.col("_s_raw"), F.col("s"), length)).alias("c"))
                       .select("c.key", "doc", "c.at", "c.n", "c.raw", "c.kind").distinct(), "contexts")
    five = ["key", "doc", "at", "n", "raw"]
    sharded = contexts.filter(f"kind = {SHARDED}").select(*five).repartition("key").sortWithinPartitions("key", "doc", "at")
    crowded = contexts.filter(f"kind = {CROWDED}").select(*five)
    fine = sharded.mapInArrow(_shards(length, SHARD), _SPANS).unionByName(
        met(crowded.mapInArrow(_strings(buckets, length), "bucket int, blob binary")))
    gone = spans.unionByName(written(fine, "fine")).filter(f"kind = {GONE}").groupBy("doc").agg(
        F.collect_list(F.struct("at", "n", "seen")).alias("_s_spans")).withColumnRenamed("doc", "_s_of")
    joined = raw.join(gone, F.col("_s_doc") == F.col("_s_of"), "left")
    return joined.select("_row", _kept(F.col("_s_raw"), F.col("_s_spans"), length).alias("_s_out")).select(
        "_row.*", F.col("_s_out").alias(out)), out
