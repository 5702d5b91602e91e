"""64-bit hashes of the words and shingles of many texts at once, with numpy.

A word's hash is a polynomial over random values of its bytes, taken from prefix sums
modulo 2**64 of the whole buffer, so a batch of texts costs a few passes over its bytes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9FB21C651E98DF25
_MASK = 2**64 - 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# For features: everything in ASCII but letters and digits parts words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of ``base``; kept for buffers of usual size."""
    held = _powers.get(base)
    if held is not None and len(held) >= n:
        return held[:n]
    out = np.empty(max(n, 1 << 16), np.uint64)
    out[0], size = 1, 1
    while size < len(out):
        more = min(size, len(out) - size)
        np.multiply(out[:more], np.uint64(pow(base, size, 2**64)), out=out[size:size + more])
        size += more
    if len(out) <= 1 << 22:
        _powers[base] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a list of texts (UTF-8): places in the joined buffer, hashes, and first word of each text."""

    def __init__(self, raws: list[bytes], breaks: np.ndarray = SPACE):
        self.bytes = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        inside = np.concatenate(([False], ~breaks[self.bytes]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        first_bytes = np.zeros(len(raws) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raws], out=first_bytes[1:])
        self.first_bytes = first_bytes
        self.first = np.searchsorted(self.starts, first_bytes)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * _power(_BASE, len(self.bytes)), out=sums[1:])
        self._sums = sums

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``prefix`` bytes."""
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        return self.range_hashes(self.starts, ends)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each range of bytes."""
        raw = (self._sums[ends] - self._sums[starts]) * _power(_INVERSE, len(self.bytes))[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts, and the first shingle of each text.

    A text with fewer words (but at least one) has its whole sequence as one shingle.
    """
    h, counts = words.hashes(), np.diff(words.first)
    numbers = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(numbers, out=first[1:])
    owner = np.repeat(np.arange(len(counts)), numbers)
    at = np.arange(first[-1]) - first[owner] + words.first[owner]
    width = np.minimum(counts, k)[owner]
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        add = h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else out
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & _MASK)
        out = out + np.where(j < width, mix(add + factor), 0).astype(np.uint64) * factor
    return mix(out + width.astype(np.uint64)), first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, in order, and the first of each text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(first)))
