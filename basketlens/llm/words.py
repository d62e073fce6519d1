"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return; A-Z are lower-cased. Every word gets a 64-bit hash: a polynomial over a
fixed random table, from prefix sums modulo 2^64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Text that is worked on at once: some forty times as many bytes of arrays, which two workers an executor hold at the same time.
SLICE_BYTES = 1 << 17

_RNG = np.random.default_rng(20260101)
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_EXACT = _LETTER.copy()
_LETTER[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# Bytes between terms: all of ASCII but letters and digits.
NO_TERM = np.arange(256) < 128
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (uint64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if n > 8 * SLICE_BYTES:
            return tables
        _powers[:] = tables
    return _powers


@dataclass
class Words:
    """Words of the texts first..first+texts-1 of a column; `text` counts from 0 within the slice."""

    first: int
    texts: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """Position of each text's first word, and the number of all words at the end."""
        return np.searchsorted(self.text, np.arange(self.texts + 1))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, bytes, offsets) of about SLICE_BYTES each; a null text is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        at = offsets[first : last + 1]
        yield first, last - first, data[at[0] : at[-1]], at - at[0]
        first = last


def _punctuation(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII punctuation, of Latin-1 signs and of U+2000-206F and U+3000-303F."""
    out = _PUNCTUATION[data]
    high = np.flatnonzero(data >= 0xC2)
    for size, lead in ((2, data == 0xC2), (3, data == 0xE2), (3, data == 0xE3)):
        at = high[lead[high]]
        at = at[at + size <= len(data)]
        first = data[at]
        second = data[at + 1]
        if size == 2:
            at = at[~np.isin(second, (0xAA, 0xB5, 0xBA))]
        else:
            at = at[(second == 0x80) | ((first == 0xE2) & (second == 0x81))]
        for k in range(size):
            out[at + k] = True
    return out


def _prefix(data: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the letters times powers, and the inverse powers, from which any run's hash follows."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _runs(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes start..end."""
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end position of each run of marked bytes; runs end with their text."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    before[edges] = False
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(column: pa.Array, bare: bool = False, breaks: np.ndarray = _SPACE, fold: bool = True) -> Iterator[Words]:
    """Words of the texts; `bare` ones without punctuation at their ends, unless they are nothing else.

    `breaks` marks the bytes that stand between words. Without `fold` A-Z stay what they are.
    """
    for first, texts, data, offsets in slices(column):
        start, end = _edges(~breaks[data], offsets)
        if bare and len(start):
            solid = np.flatnonzero(~_punctuation(data))
            left, right = np.searchsorted(solid, start), np.searchsorted(solid, end)
            some = np.flatnonzero(left < right)
            start[some], end[some] = solid[left[some]], solid[right[some] - 1] + 1
        sums, down = _prefix(data, _LETTER if fold else _EXACT)
        text = np.searchsorted(offsets, start, "right") - 1
        yield Words(first, texts, data, start, end, text, _runs(sums, down, start, end))


def repeated_lines(column: pa.Array) -> np.ndarray:
    """Of each text the lines with a word that equal an earlier one, byte by byte (by a 64-bit hash)."""
    out = [np.zeros(0, np.int64)]
    for _, texts, data, offsets in slices(column):
        start, end = _edges(data != 10, offsets)
        solid = np.concatenate([[0], np.cumsum(~_SPACE[data])])
        some = solid[end] > solid[start]
        start, end = start[some], end[some]
        sums, down = _prefix(data, _EXACT)
        line, text = _runs(sums, down, start, end), np.searchsorted(offsets, start, "right") - 1
        order = np.lexsort((line, text))
        again = (np.diff(line[order].view(np.int64)) == 0) & (np.diff(text[order]) == 0)
        out.append(np.bincount(text[order][1:][again], minlength=texts))
    return np.concatenate(out)


def word_hashes(text: str, bare: bool = False) -> np.ndarray:
    """Hashes of one text's words, in order."""
    found = [w.hash for w in words(pa.array([text], pa.large_string()), bare)]
    return found[0] if found else np.zeros(0, np.uint64)


def joined(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of `length` successive words of `hashes` (runs may cross texts)."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, (salt * 2 + 1) * _BASE % 2**64, np.uint64)
    for k in range(length):
        out = mix(out * np.uint64(_BASE) + hashes[k : k + count])
    return out
