"""Hashed words and five-word shingles of whole texts, vectorised over batches.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z. A word's hash is
a polynomial over random byte values modulo 2**64, taken from prefix sums and
mixed; a shingle's hash combines those of its words in order. With 64 bits, two
different shingles of one compared pair of documents share a hash with a
probability below 1e-9 for sets of 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20_240_229)
_BYTES = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_BASE = np.uint64(0x9E6C63D0876A9A47)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ORDER = _rng.integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)])) for base in (_BASE, _BASE_INVERSE))
    return _powers


def word_hashes(texts: list[str | None], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start (one more)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = np.concatenate([[False], ~space[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    power, inverse = _power(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * power[: len(data)])])
    hashes = mix((sums[stops] - sums[starts]) * inverse[starts])
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingle_sets(texts: list[str | None], words: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    for at in range(0, len(texts), 128):
        yield from _shingle_sets(texts[at : at + 128], words)


def _shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    w, at = word_hashes(texts)
    full = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for k in range(words):
        full += w[k : k + len(full)] * _ORDER[k]
    full = mix(full)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            yield np.unique(full[a : b - words + 1])
        elif b > a:
            yield mix((w[a:b] * _ORDER[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
