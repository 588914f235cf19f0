"""Token ids as directly addressable codes.

An id is split into chunks of ``bits`` bits, lowest first. Level 0 holds the first chunk of every id, level 1
the second chunk of the ids that go on, and so on. Each level has a bitmap that marks the chunks that go on,
and a directory with the number of marks before every block of 512. The chunk of id i on the next level
stands at the number of marks before i: a directory entry and the bits of one block give it, so any id is
reached without decoding what lies before.

Layout, little-endian: ``DAC1``, bits, levels (bytes), two zero bytes, count (8 bytes); then per level its length
(8 bytes), chunks (1, 2 or 4 bytes each), bitmap (whole bytes, lowest bit first), directory (8 bytes an entry).
"""

from __future__ import annotations

import struct

import numpy as np

BITS = 8
BLOCK = 512
MAGIC = b"DAC1"


def _width(bits: int) -> np.dtype:
    return np.dtype("u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4")


def pack(ids: np.ndarray, bits: int = BITS) -> bytes:
    """Encode unsigned 32-bit ids."""
    rest = np.asarray(ids, dtype=np.uint64)
    levels, mask = [], np.uint64((1 << bits) - 1)
    while True:
        above = rest >> np.uint64(bits)
        goes_on = above > 0
        marks = np.concatenate([[0], np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK), dtype=np.int64))]) \
            if len(rest) else np.zeros(1, np.int64)
        levels.append(b"".join([
            struct.pack("<Q", len(rest)), (rest & mask).astype(_width(bits)).tobytes(),
            np.packbits(goes_on, bitorder="little").tobytes(), marks.astype("<u8").tobytes(),
        ]))
        rest = above[goes_on]
        if not len(rest):
            break
    return struct.pack("<4sBBHQ", MAGIC, bits, len(levels), 0, len(ids)) + b"".join(levels)


class Codes:
    """Reads packed ids in place."""

    def __init__(self, data: bytes):
        magic, self.bits, n, _, self.count = struct.unpack_from("<4sBBHQ", data)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at, width = 16, _width(self.bits)
        self.levels = []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, width, size, at + 8)
            at += 8 + chunks.nbytes
            bitmap = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            at += bitmap.nbytes
            marks = np.frombuffer(data, "<u8", (size + BLOCK - 1) // BLOCK + 1, at)
            at += marks.nbytes
            self.levels.append((chunks, bitmap, marks))

    def __len__(self) -> int:
        return self.count

    def _marks_before(self, level: int, i: int) -> int:
        _, bitmap, marks = self.levels[level]
        block = i // BLOCK
        bits = np.unpackbits(bitmap[block * BLOCK // 8:(i + 7) // 8], bitorder="little")[: i - block * BLOCK]
        return int(marks[block]) + int(bits.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (self.bits * level)
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self._marks_before(level, i)
        return value

    def slice(self, start: int, length: int) -> np.ndarray:
        """Ids start to start + length."""
        out = np.zeros(length, dtype=np.uint32)
        where = np.arange(length)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if not length:
                break
            out[where] |= chunks[start:start + length].astype(np.uint32) << np.uint32(self.bits * level)
            first = start // 8
            bits = np.unpackbits(bitmap[first:(start + length + 7) // 8], bitorder="little")
            goes_on = bits[start - first * 8:][:length].astype(bool)
            if not goes_on.any():
                break
            start, where = self._marks_before(level, start), where[goes_on]
            length = len(where)
        return out
