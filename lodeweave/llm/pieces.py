"""Texts cut into pieces, in numpy and Arrow: each distinct piece is looked at once and remembered, the rest is gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once; a longer text is a batch of its own.
PIECE_BYTES = 2 << 20
#: Distinct pieces, and bytes of them, that a task remembers.
REMEMBERED, REMEMBERED_BYTES = 500_000, 16 << 20

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: Second bytes of U+00C0 to U+00FF that are letters, behind the byte ``LATIN``.
LATIN = 0xC3
LATIN_LETTER = np.zeros(256, bool)
LATIN_LETTER[0x80:0xC0] = True
LATIN_LETTER[[0x97, 0xB7]] = False


def batched(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[slice]:
    """Rows whose texts have about ``size`` bytes together, as slices in order."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield slice(at, end)
        at = end


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and where each begins, with the end; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    _, where, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(where, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def after_letter(raw: np.ndarray) -> np.ndarray:
    """Whether a letter (A-Z, a-z, U+00C0 to U+00FF) ends right before each byte."""
    out = np.zeros(len(raw), bool)
    out[1:] = LETTER[raw[:-1]]
    out[2:] |= LATIN_LETTER[raw[1:-1]] & (raw[:-2] == LATIN)
    return out


def cut(raw: np.ndarray, bounds: np.ndarray, starts: np.ndarray, dropped: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces, which one stands at each place, and the place of each text's first piece, with the end.

    ``starts`` tells where pieces begin (the first byte of a text does in any case); ``dropped`` bytes belong to none.
    """
    starts = starts.copy()
    starts[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    if dropped is not None:
        starts[1:] |= dropped[:-1]
        starts &= ~dropped
        at = np.flatnonzero(starts)
        place = np.cumsum(~dropped, dtype=np.int32)
        offsets = np.append(place[at] - 1, place[-1] if len(place) else 0)
        raw = raw[~dropped]
    else:
        at = np.flatnonzero(starts)
        offsets = np.append(at, len(raw))
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = pieces.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), np.searchsorted(at, bounds)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``which`` runs of ``flat`` end to end, and where each ends."""
    n = length[which]
    ends = np.cumsum(n, dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return flat[:0], ends
    return flat[np.arange(ends[-1], dtype=np.int32) + np.repeat((start[which] - ends + n).astype(np.int32), n)], ends


class Remembered:
    """Values (runs of numbers) of the pieces met so far; all are forgotten at once when they become too many."""

    def __init__(self, values_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = REMEMBERED) -> None:
        """``values_of`` gives the values of new pieces end to end and how many each has; ``most`` pieces are remembered."""
        self.values_of, self.most = values_of, most
        self.forget()

    def forget(self) -> None:
        self.known: pa.Array = pa.array([], pa.binary())
        self.flat = None
        self.start = self.length = np.zeros(0, np.int32)

    def __call__(self, pieces: pa.Array) -> np.ndarray:
        """The number of each of these distinct pieces, by which ``start`` and ``length`` tell its values in ``flat``."""
        place = np.asarray(pc.fill_null(pc.index_in(pieces, self.known), -1))
        new = np.flatnonzero(place < 0)
        if len(self.known) + len(new) > self.most or self.known.nbytes > REMEMBERED_BYTES:
            self.forget()
            place = np.full(len(pieces), -1)
            new = np.arange(len(pieces))
        if len(new):
            added = pieces.take(pa.array(new))
            flat, length = self.values_of(added.to_pylist())
            before = 0 if self.flat is None else len(self.flat)
            place = place.copy()
            place[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, added])
            self.start = np.concatenate([self.start, (before + np.cumsum(length) - length).astype(np.int32)])
            self.length = np.concatenate([self.length, length.astype(np.int32)])
            self.flat = flat if self.flat is None else np.concatenate([self.flat, flat])
        return place

    def values(self, pieces: pa.Array, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``pieces[which]`` end to end, and where each ends."""
        place = self(pieces)
        if self.flat is None:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return gather(self.flat, self.start, self.length, place[which])
