"""Vectorised reading of the words of texts: hashes and places, without keeping a Python object for each word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_rng = np.random.default_rng(20240229)
#: One value for each byte; fixed by the seed, so that all workers agree.
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_slices(data: bytes, at_once: int = 1 << 20) -> Iterator[bytes]:
    """A text in slices of about so many bytes that end at white space."""
    at = 0
    while len(data) - at > at_once and (gap := _WHITE.search(data, at + at_once)):
        yield data[at : gap.start()]
        at = gap.start()
    yield data[at:]


def word_hashes(data: bytes, seed: int = 0) -> np.ndarray:
    """XXH3 of each word of a text, words being runs without ASCII white space."""
    parts = []
    for piece in word_slices(data):
        words = piece.split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def runs_hash(words: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A hash of each run of `width` consecutive words (given as hashes), by a tree of mixing steps that has no algebra to it."""
    salt = np.uint64((int(_ODD) * (2 * lane + 1)) & ((1 << 64) - 1))
    join = lambda a, b: mixed(mixed(a + salt) ^ (b * _ODD))
    have, power, done, out = 1, words, 0, words[:0]
    while True:  # runs of 1, 2, 4 ... words, put together by the binary digits of width
        if width & have:
            out = power if not done else join(out[: max(0, len(words) - done - have + 1)], power[done:])
            done += have
        have *= 2
        if have > width:
            return out[: max(0, len(words) - width + 1)]
        power = join(power[: max(0, len(power) - have // 2)], power[have // 2 :])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words; of fewer words the whole sequence is the one run, of none a run of none."""
    n = min(len(words), width)
    return runs_hash(words, n, n) if n else np.zeros(1, np.uint64)


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A quick hash of each data[start:end] of up to a few million bytes, for look-ups that compare what they find."""
    if not _powers or len(_powers[0]) <= len(data):
        size = max(1 << 16, 1 << len(data).bit_length())
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    up, down = _powers
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def buffers(text: pa.Array, bytes_at_once: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about so many bytes; null counts as empty."""
    text = text.fill_null("").cast(pa.large_string())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + bytes_at_once, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Table:
    """A hash table from uint64 (not 0) to 0, 1, 2 ... in order of arrival, by open addressing."""

    def __init__(self, bits: int = 16):
        self.keys, self.values, self.shift, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64(64 - bits), 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * _ODD) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values, -1 for absent keys."""
        out, at, rest = np.full(len(h), -1, np.int32), self._slots(h), np.arange(len(h))
        while len(rest):
            there = self.keys[at]
            hit = there == h[rest]
            out[rest[hit]] = self.values[at[hit]]
            on = ~hit & (there != 0)
            rest, at = rest[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """Adds distinct absent keys."""
        if 2 * (self.size + len(h)) > len(self.keys):
            old = self.keys[self.keys != 0], self.values[self.keys != 0]
            bits = int(2 * (self.size + len(h))).bit_length() + 1
            self.keys, self.values, self.shift = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64(64 - bits)
            self._put(*old)
        self._put(h, np.arange(self.size, self.size + len(h), dtype=np.int32))
        self.size += len(h)

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        at = self._slots(h)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = h[won], values[won]
            on = np.ones(len(h), bool)
            on[won] = False
            h, values, at = h[on], values[on], (at[on] + 1) & (len(self.keys) - 1)
