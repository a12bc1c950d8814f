"""Small per-document helpers shared by the word-shingle operators: word hashes and shingle hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time, up to the end of a word.
_PIECE = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, kept for later calls; callers take texts in pieces, so this stays small."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = _POWERS[base] = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _FINAL
    return x ^ (x >> np.uint64(29))


class Words:
    """Hashes of the words of a text: runs of bytes that are not separators, with A-Z read as a-z."""

    def __init__(self, separators: bytes) -> None:
        self.inside = np.ones(256, np.int8)
        self.inside[list(separators)] = 0
        values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
        self.values = values

    def __call__(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, np.uint8)
        found = []
        while len(raw) > _PIECE:
            rest = np.flatnonzero(self.inside[raw[_PIECE:]] == 0)
            cut = _PIECE + (int(rest[0]) if len(rest) else len(raw))
            found.append(self._piece(raw[:cut]))
            raw = raw[cut:]
        found.append(self._piece(raw))
        return np.concatenate(found) if len(found) > 1 else found[0]

    def _piece(self, raw: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(raw) + 2, np.int8)
        edge[1:-1] = self.inside[raw]
        turns = np.flatnonzero(edge[1:] != edge[:-1])
        start, end = turns[::2], turns[1::2]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * _powers(_BASE, len(raw)), out=total[1:])
        return mix((total[end] - total[start]) * _powers(_INVERSE, len(raw) + 1)[start])


#: Words end at ASCII white space.
SPACED = Words(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters, digits and bytes of other characters.
ALPHANUMERIC = Words(bytes(b for b in range(128) if not chr(b).isalnum()))


def shingles(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` words; a shorter sequence is one run, an empty one has none."""
    n = len(hashes)
    k = min(size, n)
    if not k:
        return np.zeros(0, np.uint64)
    out = hashes[: n - k + 1].copy()
    for i in range(1, k):
        out *= _MULTIPLIER
        out += hashes[i : n - k + 1 + i]
    return mix(out + np.uint64(k))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
