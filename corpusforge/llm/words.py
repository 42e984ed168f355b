"""Words of UTF-8 buffers as 64-bit hashes, for whole Arrow slices at a time.

A hash is a sum of one random 64-bit number per byte value times one odd number per
position in the word (modulo 2**64), finished by a bit mixer, so that prefixes of a
word cost one subtraction each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTER, DIGIT, SYMBOL = 1, 2, 3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective bit mixer on unsigned 64-bit integers (splitmix64's finisher)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers; a longer request begins with the same ones."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * _GOLDEN + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def text_classes() -> np.ndarray:
    """Letters (bytes from 0x80 on included), digits, other visible characters; 0 between words."""
    t = np.zeros(256, dtype=np.uint8)
    t[0x21:0x7F] = SYMBOL
    t[0x30:0x3A] = DIGIT
    t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = LETTER
    return t


def space_classes() -> np.ndarray:
    """1 for every byte but U+0020 and U+0009 to U+000D."""
    t = np.ones(256, dtype=np.uint8)
    t[[0x20, *range(0x09, 0x0E)]] = 0
    return t


LOWER = lower_table()
_BYTES = numbers(256, 1)[LOWER]
_positions = numbers(1024, 2) | np.uint64(1)


@dataclass
class Words:
    doc: np.ndarray      # row of the text
    start: np.ndarray    # first byte in the buffer
    length: np.ndarray   # bytes
    kind: np.ndarray     # class of its bytes
    code: np.ndarray     # hash of the lower-cased word
    sums: np.ndarray     # running sums, for prefixes

    def prefix(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes (of words with at least ``n``)."""
        with np.errstate(over="ignore"):
            return mix(self.sums[self.start + n] - self.sums[self.start] + np.uint64(n) * _GOLDEN)


def split(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Words:
    """Words of all texts of a buffer: runs of bytes of one class other than 0, within a text."""
    global _positions
    n = len(data)
    empty = np.zeros(0, dtype=np.int64)
    if n == 0:
        return Words(empty, empty, empty, np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(1, np.uint64))
    kind = classes[data]
    edge = np.ones(n, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    first = offsets[:-1]
    edge[first[first < n]] = True
    start = np.flatnonzero(edge)
    length = np.diff(np.append(start, n))
    if len(_positions) <= (most := int(length.max())):
        _positions = numbers(2 * most, 2) | np.uint64(1)
    where = np.arange(n, dtype=np.int64) - np.repeat(start, length)
    sums = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTES[data] * _positions[where], out=sums[1:])
        used = kind[start] > 0
        start, length = start[used], length[used]
        code = mix(sums[start + length] - sums[start] + length.astype(np.uint64) * _GOLDEN)
    return Words(np.searchsorted(offsets, start, side="right") - 1, start, length, kind[start], code, sums)
