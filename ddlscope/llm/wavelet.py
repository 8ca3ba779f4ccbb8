"""Wavelet matrix over token ids, and its file format.

The ids are stored as bit planes, highest bit first; each plane holds the ids in
the order left by a stable split on the planes before it (zeros first).  With
rank and select on the planes one file answers: the id at a place, how often an
id occurs before a place, and where its k-th occurrence is.

File: an 8-byte mark, then little-endian u64: number of ids, documents and
planes; then sections, each a u64 length and zstd data: document ids (i64),
document starts (i64, one more than documents), and for each plane its bits
(packed, first bit highest) and the number of ones before every 4,096th bit (u32).
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MARK = b"WAVELET1"
EVERY = 4096


def encode(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """File content for the ids of documents; document i has ids[starts[i]:starts[i + 1]]."""
    ids = np.asarray(ids, np.uint32)
    planes = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    packer = zstandard.ZstdCompressor(level=1)
    out = [MARK, struct.pack("<3Q", len(ids), len(doc_ids), planes)]

    def section(a: np.ndarray) -> None:
        data = packer.compress(a.tobytes())
        out.extend((struct.pack("<Q", len(data)), data))

    section(np.asarray(doc_ids, "<i8"))
    section(np.asarray(starts, "<i8"))
    now = ids.astype(np.uint16) if planes <= 16 else ids
    for plane in range(planes - 1, -1, -1):
        bit = (now >> plane & 1).astype(bool)
        section(np.packbits(bit))
        section(np.concatenate([[0], np.cumsum(np.add.reduceat(bit, np.arange(0, len(bit), EVERY), dtype=np.int64))]).astype("<u4")
                if len(bit) else np.zeros(1, "<u4"))
        now = np.concatenate([now[~bit], now[bit]])
    return b"".join(out)


class WaveletMatrix:
    """Reads a file's content; planes are unpacked as they are used."""

    def __init__(self, content: bytes):
        if content[:8] != MARK:
            raise ValueError("not a wavelet file")
        self.n, self.n_docs, self.planes = struct.unpack_from("<3Q", content, 8)
        unpacker = zstandard.ZstdDecompressor()
        at, sections = 32, []
        while at < len(content):
            (size,) = struct.unpack_from("<Q", content, at)
            sections.append(unpacker.decompress(content[at + 8:at + 8 + size]))
            at += 8 + size
        self.doc_ids = np.frombuffer(sections[0], "<i8")
        self.starts = np.frombuffer(sections[1], "<i8")
        self.bits = [np.frombuffer(s, np.uint8) for s in sections[2::2]]
        self.ones_before = [np.frombuffer(s, "<u4") for s in sections[3::2]]
        self.zeros = [self.n - int(o[-1]) for o in self.ones_before]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        block = i // EVERY
        part = self.bits[plane][block * EVERY // 8:(i + 7) // 8]
        tail = np.unpackbits(part)[:i - block * EVERY]
        return int(self.ones_before[plane][block]) + int(tail.sum())

    def _bit(self, plane: int, i: int) -> int:
        return int(self.bits[plane][i >> 3] >> (7 - (i & 7)) & 1)

    def _select(self, plane: int, k: int, bit: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        counts = self.ones_before[plane].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * EVERY, self.n) - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        part = np.unpackbits(self.bits[plane][block * EVERY // 8:(block + 1) * EVERY // 8])[:self.n - block * EVERY]
        return block * EVERY + int(np.flatnonzero(part == bit)[k - counts[block]])

    def access(self, i: int) -> int:
        value = 0
        for plane in range(self.planes):
            bit = self._bit(plane, i)
            ones = self._rank1(plane, i)
            value = value << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences before place ``i`` lie after the last plane."""
        low, high = 0, i
        for plane in range(self.planes):
            a, b = self._rank1(plane, low), self._rank1(plane, high)
            if token >> (self.planes - 1 - plane) & 1:
                low, high = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, upto: int | None = None) -> int:
        """Occurrences of a token before place ``upto`` (in the whole file)."""
        if token >> self.planes:
            return 0
        low, high = self._range(token, self.n if upto is None else upto)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        if k < 0 or k >= self.count(token):
            raise IndexError(k)
        at = self._range(token, self.n)[0] + k
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            at = self._select(plane, at - self.zeros[plane] if bit else at, bit)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order."""
        # from the last plane upwards: undo each stable split
        value = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in range(self.planes - 1, -1, -1):
            bit = np.unpackbits(self.bits[plane], count=self.n).astype(bool)
            moved = np.empty_like(value)
            moved[~bit] = value[:self.zeros[plane]]
            moved[bit] = value[self.zeros[plane]:] | value.dtype.type(1 << (self.planes - 1 - plane))
            value = moved
        return value.astype(np.uint32)
