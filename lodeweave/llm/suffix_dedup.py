"""Removal of byte strings that an earlier document holds, by suffix sorting.

Texts are cut where they agree by content: of any ``SPAN`` consecutive bytes, the k-gram with the smallest hash is an
anchor, so equal strings of that length hold an anchor at the same place. Anchors that only one document has are left out
(an anchor counts as shared when another document has it with the same 19 bytes before it or the same 19 behind it, as any
common string of ``SPAN`` bytes implies), and the surroundings of the others come together by anchor. There the suffixes
are sorted in two stages: those smaller than their successors directly, the others by scanning the buckets of first bytes
upwards, as a suffix larger than its successor follows it in order. Neighbours in the suffix array with a common prefix of
``SPAN`` bytes are copies, and of these all go but those of the smallest id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.pieces import gather, raw_bytes
from lodeweave.llm.text import _BASE, _INVERSE, _powers, mix, slices
from lodeweave.operators.materialize import materialize

SPAN, GRAM = 50, 12
REACH = SPAN - GRAM
SIDE = (REACH + 1) // 2
#: Text per slot of anchors, in bytes; anchors held at once; surroundings sorted at once.
SLOT_BYTES, HELD, CHUNK = 1 << 20, 1 << 20, 30_000
#: Bytes of a long text that are looked at together.
PIECE = 1 << 20
#: Where surroundings stand.
PLACE = np.dtype([("doc", "<i8"), ("start", "<i4")])
_VALUES = np.random.default_rng(10).integers(1, 1 << 63, 256, dtype=np.uint64)


def _sliding(f: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """``f`` (minimum or maximum) over each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, their hashes, and 12-bit hashes (0: none) of the bytes before and behind.

    A long text is looked at in pieces with a margin on both sides, as all this depends on the nearest ``SPAN`` bytes only.
    """
    n = len(raw)
    if n > 2 * PIECE:
        found = []
        for at in range(0, n, PIECE):
            low = max(0, at - 2 * SPAN)
            places, *others = anchors(raw[low : at + PIECE + 2 * SPAN])
            own = (places + low >= at) & (places + low < at + PIECE)
            found.append([x[own] for x in (places + low, *others)])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint16)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[raw] * _powers(_BASE, n), out=total[1:])
    back = _powers(_INVERSE, n + 1)
    grams = mix((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])
    width = REACH + 1
    edge = np.zeros(width - 1, np.uint64)
    least = _sliding(np.minimum, grams, width)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), width) == grams)

    def side(start: np.ndarray) -> np.ndarray:
        inside = (start >= 0) & (start + SIDE <= n)
        start = np.where(inside, start, 0)
        found = (mix((total[start + SIDE] - total[start]) * back[start]) >> np.uint64(52)).astype(np.uint16)
        return np.where(inside, np.maximum(found, 1), 0).astype(np.uint16)

    return at, grams[at], side(at - SIDE), side(at + GRAM)


def anchor_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashes of the anchors at these positions."""
    return mix((_VALUES[raw[at[:, None] + np.arange(GRAM)]] * _powers(_BASE, GRAM)).sum(1, dtype=np.uint64))


# shared anchors

_COLUMNS = (("hash", np.uint32), ("left", np.uint16), ("right", np.uint16), ("doc", np.int64), ("at", np.uint32))
#: As stored: how many bytes of each value, lowest first. Within a slot, three bytes of a hash tell anchors apart well enough.
_STORED = (("hash", np.uint32, 3), ("sides", np.uint32, 3), ("doc", np.int64, 8), ("at", np.uint32, 4))
Records = dict[str, np.ndarray]


def _to_blob(records: Records) -> bytes:
    """By column and within it by byte, documents as differences, so that the shuffle's compression finds the zeros."""
    sides = (records["left"].astype(np.uint32) << np.uint32(12)) | records["right"]
    stored = {"hash": records["hash"], "sides": sides, "doc": np.diff(records["doc"], prepend=0), "at": records["at"]}
    return b"".join(stored[c].astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T[:kept].tobytes() for c, kind, kept in _STORED)


def _from_blob(blob: bytes) -> Records:
    count, offset, stored = len(blob) // sum(kept for _, _, kept in _STORED), 0, {}
    for c, kind, kept in _STORED:
        planes = np.zeros((count, np.dtype(kind).itemsize), np.uint8)
        planes[:, :kept] = np.frombuffer(blob, np.uint8, count * kept, offset).reshape(kept, count).T
        stored[c] = planes.view(kind)[:, 0]
        offset += count * kept
    sides = stored.pop("sides")
    return stored | {"doc": np.cumsum(stored["doc"]), "left": (sides >> np.uint32(12)).astype(np.uint16), "right": (sides & np.uint32(0xFFF)).astype(np.uint16)}


def _joined(parts: list[Records]) -> Records:
    return {c: np.concatenate([p[c] for p in parts]) for c, _ in _COLUMNS}


def _taken(records: Records, which: np.ndarray) -> Records:
    return {c: x[which] for c, x in records.items()}


def _anchor_slots(slots: int) -> Callable:
    """Anchors of a task by slot of their hash, packed by column."""

    def packed(parts: list[Records], slot: np.ndarray) -> pa.RecordBatch:
        records = _joined(parts)
        order = np.argsort(slot, kind="stable")
        found, starts = np.unique(slot[order], return_index=True)
        pieces = np.split(order, starts[1:])
        blobs = [_to_blob(_taken(records, p)) for p in pieces]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], names=["slot", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Records] = []
        places: list[np.ndarray] = []
        size = 0
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                at, hashes, left, right = anchors(np.frombuffer(text or b"", np.uint8))
                if len(at):
                    parts.append({"hash": hashes.astype(np.uint32) & np.uint32(0xFFFFFF), "left": left, "right": right, "doc": np.full(len(at), doc, np.int64), "at": at.astype(np.uint32)})
                    places.append(((hashes >> np.uint64(32)) % np.uint64(slots)).astype(np.int64))
                    size += len(at)
                if size >= HELD:
                    yield packed(parts, np.concatenate(places))
                    parts, places, size = [], [], 0
        if size:
            yield packed(parts, np.concatenate(places))

    return run


def _shared(records: Records, told: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which records to emit and which must stay to tell of later ones: two for each key at most, of two documents if there are.

    Records another document shares are emitted once (``told`` marks those that were). Before the ``final`` chunk, those that
    can't stay are emitted too, as a later document may share them.
    """
    shared, stays = np.zeros(len(told), bool), np.zeros(len(told), bool)
    for side in ("left", "right"):
        valid = np.flatnonzero(records[side])
        if not len(valid):
            continue
        key = (records["hash"][valid].astype(np.uint64) << np.uint64(16)) | records[side][valid]
        order = np.lexsort((records["doc"][valid], key))
        key, which = key[order], valid[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        last = np.append(first[1:], len(key)) - 1
        several = records["doc"][which[first]] != records["doc"][which[last]]
        shared[which[np.repeat(several, last - first + 1)]] = True
        stays[which[first]] = stays[which[last]] = True
    if not final:
        shared |= ~stays & ((records["left"] | records["right"]) > 0)
    return shared & ~told, stays


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, at`` (binary positions) of shared anchors; rows come by slot, and of a slot only distinct anchors are held."""
    slot, kept, new, size = None, None, [], 0
    known = np.zeros(0, bool)  # which of those kept are emitted

    def settled(final: bool) -> pa.RecordBatch | None:
        nonlocal kept, known, new, size
        records = _joined(([kept] if kept else []) + new)
        told = np.zeros(len(records["doc"]), bool)
        told[: len(known)] = known
        shared, stays = _shared(records, told, final)
        kept, known, new, size = _taken(records, stays), (told | shared)[stays], [], 0
        if not shared.any():
            return None
        docs, at = records["doc"][shared], records["at"][shared]
        order = np.argsort(docs, kind="stable")
        found, starts = np.unique(docs[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array([x.tobytes() for x in np.split(at[order], starts[1:])], pa.binary())], names=["doc_id", "at"])

    for batch in batches:
        for own, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != slot or size >= HELD:
                if size and (out := settled(own != slot)):
                    yield out
                if own != slot:
                    slot, kept, known = own, None, known[:0]
            records = _from_blob(blob)
            new.append(records)
            size += len(records["doc"])
    if size and (out := settled(True)):
        yield out


# surroundings and their suffixes


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``anchor, around, places``: up to ``REACH`` bytes before each shared anchor and as many behind it, and where they stand.

    Equal surroundings of the texts of one piece of a task are one row; its ``places`` are documents and offsets (``PLACE``).
    """
    parts: list[tuple[np.ndarray, ...]] = []
    texts: list[bytes] = []
    size = 0

    def combined() -> pa.RecordBatch:
        anchor, doc, start, first, past = (np.concatenate(x) for x in zip(*parts, strict=True))
        raw, base = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])[:-1]
        first = first + np.repeat(base, [len(x[0]) for x in parts])
        around = _binary(*gather(raw, first, past, np.arange(len(first)))).dictionary_encode()
        order = np.lexsort((np.asarray(around.indices), anchor))
        code, anchor = np.asarray(around.indices)[order], anchor[order]
        heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (code[1:] != code[:-1])]))
        places = np.empty(len(order), PLACE)
        places["doc"], places["start"] = doc[order], start[order]
        packed = _binary(places.view(np.uint8), np.append(heads[1:], len(order)) * PLACE.itemsize)
        return pa.RecordBatch.from_arrays([pa.array(anchor[heads]), around.dictionary.take(pa.array(code[heads])), packed], names=["anchor", "around", "places"])

    for batch in slices(batches):
        for doc, text, lists in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            wanted = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in lists])).astype(np.int64)
            for k in range(0, len(wanted), CHUNK):  # of a long text as far as these anchors reach
                own = wanted[k : k + CHUNK]
                start = np.maximum(own - REACH, 0)
                low, past = start[0], np.minimum(own + SPAN, len(text))
                texts.append(text[low : past[-1]])
                parts.append((anchor_hashes(np.frombuffer(text, np.uint8), own).view(np.int64), np.full(len(own), doc), start, start - low, past - start))
                size += len(own)
                if size >= CHUNK:
                    yield combined()
                    parts, texts, size = [], [], 0
    if size:
        yield combined()


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings that lie end to end."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def sort_suffixes(raw: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` positions of ``raw`` in the order of their suffixes, to a depth of ``SPAN`` bytes at least, and
    whether each has these bytes in common with the one before it.
    """
    size = len(raw)
    text = np.concatenate([raw, np.zeros(64, np.uint8)])
    words = np.zeros(size + 56, np.uint64)  # eight bytes from each position on, first byte highest
    for k in range(8):
        words = (words << np.uint64(8)) | text[k : k + size + 56]
    step = np.sign(text[1 : size + 1].astype(np.int16) - raw)
    turn = np.minimum.accumulate(np.where(step != 0, np.arange(size), size)[::-1])[::-1]
    small = np.append(step, 1)[turn] > 0  # smaller than its successor

    used = np.zeros(size, bool)
    used[wanted] = True
    ahead = wanted
    while len(ahead := ahead[~small[ahead]] + 1) and len(ahead := ahead[ahead < size]):
        ahead = np.unique(ahead[~used[ahead]])
        used[ahead] = True
    chosen = np.flatnonzero(used)
    direct, induced = chosen[small[chosen]], chosen[~small[chosen]]
    direct = direct[np.lexsort([words[direct + 8 * k] for k in range(6, -1, -1)])]

    rank = np.full(size + 1, -1, np.int64)  # the end of the text comes before all
    ranked, out = 0, []
    run = turn - np.arange(size)  # equal bytes that follow
    for byte in range(256):
        own = induced[raw[induced] == byte]
        groups = [g for n in np.unique(run[own]) for g in [own[run[own] == n]]] if len(own) else []
        for group in [*groups, direct[raw[direct] == byte]]:
            if not len(group):
                continue
            if not small[group[0]]:
                group = group[np.argsort(rank[group + 1], kind="stable")]
            rank[group] = np.arange(ranked, ranked + len(group))
            ranked += len(group)
            out.append(group)
    order = np.concatenate(out) if out else chosen
    asked = np.zeros(size, bool)
    asked[wanted] = True
    order = order[asked[order]]
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in range(0, SPAN, 8):
        part = words[order + k] >> np.uint64(8 * max(0, k + 8 - SPAN))
        same[1:] &= part[1:] == part[:-1]
    return order, same


class Rows:
    """Surroundings (``around``, by number in ``row``) of anchors, with the document and the place of each."""

    def __init__(self, anchor: np.ndarray, around: pa.Array, row: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        self.anchor, self.around, self.row, self.doc, self.start = anchor, around, row, doc, start

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        raw, bounds = raw_bytes(batch.column(2))
        places = np.ascontiguousarray(raw).view(PLACE)
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds) // PLACE.itemsize)
        return Rows(np.asarray(batch.column(0)), batch.column(1), row, places["doc"].astype(np.int64), places["start"].astype(np.int64))

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        base = np.cumsum([0, *(len(p.around) for p in parts)])
        row = np.concatenate([p.row + n for p, n in zip(parts, base.tolist(), strict=False)])
        anchor, doc, start = (np.concatenate([getattr(p, c) for p in parts]) for c in ("anchor", "doc", "start"))
        return Rows(anchor, pa.concat_arrays([p.around for p in parts]), row, doc, start)

    def split(self, at: int) -> tuple[Rows, Rows]:
        """The first ``at`` surroundings and the others."""
        cut = int(np.searchsorted(self.row, at))
        return (
            Rows(self.anchor[:at], self.around[:at], self.row[:cut], self.doc[:cut], self.start[:cut]),
            Rows(self.anchor[at:], self.around[at:], self.row[cut:] - at, self.doc[cut:], self.start[cut:]),
        )

    def settled(self) -> tuple[list[np.ndarray], Rows]:
        """``doc_id, first, past`` of spans that a smaller document has, and the rows with a string that none has.

        Equal surroundings under one anchor are of one kind: those of its smallest document stand for it, the others are
        copies. An anchor with one kind needs no sort.
        """
        coded = self.around.dictionary_encode()
        code = np.asarray(coded.indices)
        order = np.lexsort((code, self.anchor))
        new_anchor = np.concatenate([[True], np.diff(self.anchor[order]) != 0])
        new_kind = new_anchor | np.concatenate([[True], np.diff(code[order]) != 0])
        kind_of_row = np.empty(len(order), np.int64)
        kind_of_row[order] = np.cumsum(new_kind) - 1
        rows = order[new_kind]  # one of each kind
        anchor = (np.cumsum(new_anchor) - 1)[new_kind]
        length = np.asarray(pc.binary_length(coded.dictionary), np.int64)[code[rows]]

        kind = kind_of_row[self.row]
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, self.doc)
        long = length[kind] >= SPAN
        copy = (self.doc > least[kind]) & long
        spans = [self.doc[copy], self.start[copy], self.start[copy] + length[kind[copy]]]

        own = np.flatnonzero((self.doc == least[kind]) & long)
        sorted_kinds = np.flatnonzero((np.bincount(anchor)[anchor] > 1) & (length >= SPAN))
        new = np.ones(len(rows), bool)
        which, first, past, new[sorted_kinds] = _own_copies(self.around.take(pa.array(rows[sorted_kinds])), least[sorted_kinds])
        count = np.bincount(sorted_kinds[which], minlength=len(rows))
        begin = np.cumsum(count) - count
        first, _ = gather(first, begin, count, kind[own])
        past, _ = gather(past, begin, count, kind[own])
        where = np.repeat(own, count[kind[own]])
        spans = [np.concatenate(x) for x in zip(spans, [self.doc[where], self.start[where] + first, self.start[where] + past], strict=True)]

        own = own[new[kind[own]]]
        stays, row = np.unique(kind[own], return_inverse=True)
        by = np.argsort(row, kind="stable")
        return spans, Rows(self.anchor[rows[stays]], self.around.take(pa.array(rows[stays])), row[by], self.doc[own][by], self.start[own][by])


def _own_copies(around: pa.Array, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of surroundings (their number, first and past byte) that those of a smaller document hold too, by sorting the suffixes
    of all; and which hold a string that none does."""
    raw, bounds = raw_bytes(around)
    base, counts = bounds[:-1], np.diff(bounds) - SPAN + 1
    new, none = np.zeros(len(base), bool), np.zeros(0, np.int64)
    if not len(base):
        return none, none, none, new
    owner = np.repeat(np.arange(len(base)), np.diff(bounds))
    row = np.repeat(np.arange(len(base)), counts)
    order, same = sort_suffixes(raw, base[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
    heads = np.flatnonzero(~same)
    own = docs[owner[order]]
    least = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(own))))
    new[owner[order[own == least]]] = True
    first = np.sort(order[own > least])
    if not len(first):
        return none, none, none, new
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(first) > 1) | (np.diff(owner[first]) > 0)]))
    begin, end = first[cut], first[np.append(cut[1:], len(first)) - 1]
    at = owner[begin]
    return at, begin - base[at], end - base[at] + SPAN, new


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, first, past`` for bytes that an earlier document has; rows come by anchor.

    A chunk holds whole anchors as far as ``CHUNK`` allows; of an anchor that goes on, surroundings with a string not seen
    in an earlier document are carried over.
    """

    def packed(spans: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(spans, (np.int64, np.int32, np.int32), strict=True)], names=["doc_id", "first", "past"])

    held: Rows | None = None
    limit = CHUNK
    for batch in slices(batches, CHUNK):
        if not batch.num_rows:
            continue
        held = Rows.joined([held, Rows.of(batch)]) if held else Rows.of(batch)
        if len(held.doc) < limit:
            continue
        last = int(np.searchsorted(held.anchor, held.anchor[-1]))
        if last:  # the anchors that are complete
            done, held = held.split(last)
            yield packed(done.settled()[0])
            limit = CHUNK + len(held.doc)
        else:
            spans, held = held.settled()
            yield packed(spans)
            limit = 2 * max(CHUNK, len(held.doc)) if len(held.doc) else CHUNK
        held = held if len(held.doc) else None
    if held:
        yield packed(held.settled()[0])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in slices(batches):
        out = []
        for doc, text, copy, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
            text = text or b""
            raw = np.frombuffer(text, np.uint8)
            edges = np.zeros(len(raw) + 1, np.int32)
            if copy and len(raw) >= SPAN:
                spans = [{"first": 0, "past": len(raw)}]
            for s in spans or ():
                edges[s["first"]] += 1
                edges[s["past"]] -= 1
            gone = np.cumsum(edges[:-1]) > 0
            n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
            out.append((doc, len(raw), int(gone.sum()), n_spans, raw[~gone].tobytes()))
        kinds = [*[pa.int64()] * 4, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary: what stays) for each row of ``docs``.

    A byte goes if some ``SPAN`` bytes around it also start in a document with a smaller id, judged on the input. Whole
    copies of an earlier text are known by a hash and take no part in the sort. Null and short texts lose nothing. Rows
    without id neither lose nor remove anything; repeated rows are one document; of several texts under one id, each
    is searched and each loses what either one of them is found to repeat at that place.
    """
    long_id = docs.schema["doc_id"].dataType.simpleString() == "bigint"  # a needless cast would keep Spark from reusing the shuffle
    docs = docs.select("doc_id" if long_id else F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = docs.where("doc_id IS NOT NULL AND octet_length(text) > 0").select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    earliest = known.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    whole = materialize(known.join(earliest, ["h", "g"]).where("doc_id > least").select("doc_id").distinct(), "copies")

    named = docs.where("doc_id IS NOT NULL")
    base = named.repartition("doc_id")  # both joins on texts read this one shuffle
    slots = max(16, -(-total // SLOT_BYTES))
    packed = named.mapInArrow(_anchor_slots(slots), "slot long, records binary").repartition("slot").sortWithinPartitions("slot")
    shared = packed.mapInArrow(_shared_anchors, "doc_id long, at binary").join(whole, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    around = base.join(shared, "doc_id").select("doc_id", "text", "at").mapInArrow(_surroundings, "anchor long, around binary, places binary")
    copies = around.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_copies, "doc_id long, first int, past int")
    spans = copies.groupBy("doc_id").agg(F.collect_list(F.struct("first", "past")).alias("spans"))
    judged = base.join(spans, "doc_id", "left").join(whole.withColumn("copy", F.lit(True)), "doc_id", "left")
    judged = judged.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    nameless = docs.where("doc_id IS NULL").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast(judged.schema["spans"].dataType).alias("spans"))
    return judged.unionByName(nameless).mapInArrow(_judged, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    found = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS f FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT p.doc_id, p.p FROM p JOIN f ON f.s = p.s AND f.f < p.doc_id),
m AS (SELECT doc_id, p, coalesce(p - lag(p) OVER o, 51) AS gap FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
k AS (SELECT doc_id, count(*) FILTER (WHERE gap > 50) AS n_spans FROM m GROUP BY doc_id),
b AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM g),
o AS (SELECT d.doc_id, string_agg(substr(d.h, 2 * x.i + 1, 2), '' ORDER BY x.i) AS kept, count(*) AS n FROM d JOIN (SELECT doc_id, unnest(range(len(h) // 2)) AS i FROM d) x ON x.doc_id = d.doc_id WHERE (x.doc_id, x.i) NOT IN (SELECT doc_id, i FROM b) GROUP BY d.doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, (len(d.h) // 2 - coalesce(o.n, 0))::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(o.kept, ''))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)
"""
