"""Wavelet matrix over token ids: access, counts and occurrences from one compressed byte string.

Level 0 holds the highest bit of every token in text order; before each next level the
tokens with bit 0 move to the front, those with bit 1 behind them, both in order. A token is
read by following its position down the levels (rank); an occurrence is found by following
its position back up (select).

Layout (little-endian): b"WVM1", number of tokens (8 bytes), levels (1), chunks per level (4); for each
level the number of zero bits (8), then for each chunk the one bits before it (8) and its compressed
length (4); then the chunks: CHUNK_BYTES of plane bits each, a zstd frame of its own, so one
access decompresses one chunk per level. An unpacked chunk is counted once in blocks of BLOCK_BYTES; rank and select then look at one block.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

CHUNK_BYTES = 8192
CHUNK_BITS = CHUNK_BYTES * 8
# Bytes between the counts of one bits within an unpacked chunk.
BLOCK_BYTES = 64
_MAGIC = b"WVM1"


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], before: list[np.ndarray], frames: list[list[bytes]]):
        self.n, self.zeros, self.before, self.frames = n, zeros, before, frames
        self._unpacked: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def build(tokens: np.ndarray, level: int = 1) -> WaveletMatrix:
        n = len(tokens)
        x = np.ascontiguousarray(tokens, np.uint16 if n == 0 or tokens.max() < 65536 else np.uint32)
        levels = max(1, int(x.max()).bit_length()) if n else 1
        packer = zstandard.ZstdCompressor(level=level)
        zeros, before, frames = [], [], []
        for b in range(levels - 1, -1, -1):
            bit = (x & x.dtype.type(1 << b)) != 0
            plane = np.packbits(bit, bitorder="little")
            at = np.arange(0, len(plane), CHUNK_BYTES)
            ones = np.add.reduceat(np.bitwise_count(plane), at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
            first = n - int(ones.sum())
            zeros.append(first)
            before.append(np.cumsum(ones) - ones)
            frames.append([packer.compress(plane[k : k + CHUNK_BYTES].tobytes()) for k in at])
            if b:
                y = np.empty_like(x)
                y[:first] = x[~bit]
                y[first:] = x[bit]
                x = y
        return WaveletMatrix(n, zeros, before, frames)

    def to_bytes(self) -> bytes:
        chunks = len(self.frames[0])
        out = [_MAGIC, struct.pack("<QBI", self.n, len(self.zeros), chunks)]
        for zeros, before, frames in zip(self.zeros, self.before, self.frames):
            out.append(struct.pack("<Q", zeros))
            out += [struct.pack("<QI", int(b), len(f)) for b, f in zip(before, frames)]
        return b"".join(out + [f for frames in self.frames for f in frames])

    @staticmethod
    def from_bytes(data: bytes) -> WaveletMatrix:
        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n, levels, chunks = struct.unpack_from("<QBI", data, 4)
        at, zeros, before, sizes = 17, [], [], []
        for _ in range(levels):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            rows = [struct.unpack_from("<QI", data, at + 8 + 12 * k) for k in range(chunks)]
            at += 8 + 12 * chunks
            before.append(np.array([r[0] for r in rows], np.int64))
            sizes.append([r[1] for r in rows])
        frames = []
        for own in sizes:
            frames.append([])
            for size in own:
                frames[-1].append(data[at : at + size])
                at += size
        return WaveletMatrix(n, zeros, before, frames)

    def _bits(self, level: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's bytes, and the one bits before each of its blocks of BLOCK_BYTES."""
        if (level, chunk) not in self._unpacked:
            if len(self._unpacked) >= 256:
                self._unpacked.clear()
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[level][chunk]), np.uint8)
            at = np.arange(0, len(raw), BLOCK_BYTES)
            ones = np.add.reduceat(np.bitwise_count(raw).astype(np.int64), at)
            self._unpacked[level, chunk] = raw, np.cumsum(ones) - ones
        return self._unpacked[level, chunk]

    def _bit(self, level: int, i: int) -> int:
        chunk, rest = divmod(i, CHUNK_BITS)
        return int(self._bits(level, chunk)[0][rest >> 3]) >> (rest & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        """One bits before position i: those before its chunk, before its block, and in the block's bytes before it."""
        if i >= self.n:
            return self.n - self.zeros[level]
        chunk, rest = divmod(i, CHUNK_BITS)
        raw, before = self._bits(level, chunk)
        block = rest // (8 * BLOCK_BYTES)
        whole = int.from_bytes(raw[block * BLOCK_BYTES : (rest >> 3) + 1].tobytes(), "little")
        inside = whole & ((1 << (rest - block * 8 * BLOCK_BYTES)) - 1)
        return int(self.before[level][chunk]) + int(before[block]) + inside.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of the given value."""
        ones = self.before[level]
        ahead = ones if bit else np.arange(len(ones)) * CHUNK_BITS - ones
        chunk = int(np.searchsorted(ahead, k, "right")) - 1
        raw, before = self._bits(level, chunk)
        k -= int(ahead[chunk])
        counts = before if bit else np.arange(len(before)) * 8 * BLOCK_BYTES - before
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(raw[block * BLOCK_BYTES : (block + 1) * BLOCK_BYTES], bitorder="little")
        inside = int(np.flatnonzero(bits == bit)[k - int(counts[block])])
        return chunk * CHUNK_BITS + block * 8 * BLOCK_BYTES + inside

    def access(self, i: int) -> int:
        """The i-th token."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level, zeros in enumerate(self.zeros):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            token = token * 2 + bit
            i = zeros + ones if bit else i - ones
        return token

    def _span(self, token: int, end: int) -> tuple[int, int]:
        """The token's span at the bottom, of its occurrences before position end."""
        if token < 0 or token >> len(self.zeros):
            return 0, 0
        low, high = 0, min(end, self.n)
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, low), self._rank1(level, high)
            if token >> (len(self.zeros) - 1 - level) & 1:
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of the token before position end (default: in all)."""
        low, high = self._span(token, self.n if end is None else end)
        return high - low

    def occurrence(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence (from 0)."""
        low, high = self._span(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order."""
        # Two bytes a token where they are enough: this is bound by memory.
        x = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        opener = zstandard.ZstdDecompressor()
        for level in range(len(self.zeros) - 1, -1, -1):
            raw = b"".join(opener.decompress(f) for f in self.frames[level])
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[~bit] = x[: self.zeros[level]]
            y[bit] = x[self.zeros[level] :] | x.dtype.type(1 << (len(self.zeros) - 1 - level))
            x = y
        return x.astype(np.uint32)
