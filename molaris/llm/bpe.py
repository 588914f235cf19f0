"""Byte-level BPE encoding and decoding as a monoid tree.

A text is cut in halves until a leaf is short, leaves are encoded, and neighbours are joined upwards.
Joining re-encodes a window around the cut and keeps the tokens outside it:

* Between the matches of the split pattern. A place where white space follows something else, or an ASCII
  sign or digit follows a letter, ends a match whatever stands before and after it. The window grows from
  the cut to the nearest such place on either side; what lies beyond is encoded the same with or without
  the neighbour.
* Inside one very long match (no such place). Ids are the encoding of their bytes if and only if each two
  adjacent ids are the encoding of theirs. The window grows by ids until its first and last id hold with
  the ids beside it.

Decoding concatenates the bytes of the halves.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of the rank files, one match at a time is encoded.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LEAF_CHARS = 4096
LEAF_BYTES = 1024
FIRST_IDS = 8
_STARTS = frozenset(" \t\n\r")
_AFTER_LETTER = _STARTS | frozenset("0123456789!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def is_cut(text: str, i: int) -> bool:
    """Does a match of the pattern end before character i in every context?"""
    before, here = text[i - 1], text[i]
    return (here in _AFTER_LETTER and before.isalpha()) or (here in _STARTS and not before.isspace())


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.lib = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.fits = lru_cache(1 << 16)(self._fits)

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    # leaves

    def short(self, text: str) -> np.ndarray:
        return self.lib.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def short_match(self, piece: bytes) -> list[int]:
        return self.lib._encode_single_piece(piece)

    def raw(self, ids) -> bytes:
        return self.lib.decode_bytes([int(i) for i in ids])

    # one long match

    def _fits(self, a: int, b: int) -> bool:
        return self.short_match(self.raw((a, b))) == [a, b]

    def match(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.short_match(piece)
        half = len(piece) // 2
        return self.join_ids(self.match(piece[:half]), self.match(piece[half:]))

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the joined bytes of two parts of one match."""
        grow = FIRST_IDS
        while True:
            a, b = min(grow, len(left)), min(grow, len(right))
            window = self.short_match(self.raw(left[len(left) - a:]) + self.raw(right[:b]))
            before_holds = a == len(left) or self.fits(left[len(left) - a - 1], window[0])
            after_holds = b == len(right) or self.fits(window[-1], right[b])
            if before_holds and after_holds:
                return left[: len(left) - a] + window + right[b:]
            grow *= 2

    # texts

    def window(self, text: str) -> np.ndarray:
        """Encode a window. A long one has long matches, which are encoded as trees of their own."""
        if len(text) <= LEAF_CHARS:
            return self.short(text)
        ids: list[int] = []
        for found in self.pattern.finditer(text):
            ids += self.match(found.group().encode("utf-8"))
        return np.array(ids, dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= LEAF_CHARS:
            return self.short(text[start:end])
        mid = (start + end) // 2
        return self.join(text, start, mid, end, self._encode(text, start, mid), self._encode(text, mid, end))

    def join(self, text: str, start: int, mid: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[start:end] from those of its halves."""
        lo = mid - 1
        while lo > start and not is_cut(text, lo):
            lo -= 1
        hi = mid + 1
        while hi < end and not is_cut(text, hi):
            hi += 1
        lo, hi = max(lo, start), min(hi, end)
        if lo == start and hi == end:
            return self.window(text[start:end])
        drop_left = len(left) if lo == start else len(self.window(text[lo:mid]))
        drop_right = len(right) if hi == end else len(self.window(text[mid:hi]))
        return np.concatenate([left[: len(left) - drop_left], self.window(text[lo:hi]), right[drop_right:]])

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return self.lib.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(1)
def loaded(path: str) -> Bpe:
    return Bpe.load(path)


def encoded(text: Column, ranks_path: str) -> Column:
    """Ids of a text as binary: little-endian unsigned 32-bit integers. A null text counts as empty."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(ranks_path)
        for batch in batches:
            yield pa.array([bpe.encode(x.as_py() or "").astype("<u4").tobytes() for x in batch], pa.binary())

    return encode(text)


def decoded(ids: Column, ranks_path: str) -> Column:
    """Bytes of a text from its ids as ``encoded`` gives them; null ids give null."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(ranks_path)
        for batch in batches:
            yield pa.array([None if (x := y.as_py()) is None else bpe.decode(np.frombuffer(x, "<u4")) for y in batch], pa.binary())

    return decode(ids)
