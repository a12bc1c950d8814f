"""Benchmark passages in documents: SimHash windows of item size, multi-index Hamming search, exact verification.

A text is its sequence of words (letters and digits, lower-cased) and their 5-word shingles. A window that shares no
shingle with any item has similarity 0, so only windows around shared shingles are fingerprinted. The fingerprint of
a window is a 64-bit SimHash of its shingles, each as often as it occurs. Two fingerprints within ``RADIUS`` differ by
at most ``RADIUS // BLOCKS`` bits in one of their blocks, so looking up every block in the balls of that radius around
the items' blocks finds all of them. What is found is compared in full: the sum of the smaller over the sum of the
larger multiplicities of the shingles (weighted Jaccard) must reach ``SIMILARITY``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.text import ALPHANUMERIC, WORDS, distinct, mix, shingles, slices
from lodeweave.operators.materialize import discard, materialize

SIMILARITY = 0.8
RADIUS = 15
#: Blocks of eight bits; an item takes some 400 bytes in the index for its balls, and 32 for each word.
BLOCKS = 8
#: Bytes of benchmark text that one pass over the documents holds; a larger benchmark takes more passes. The index of one pass
#: stays below 40 MB with items of 100 bytes or more, and below 200 MB with items of one word.
BLOCK_BYTES = 4 << 20
_BALL = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(64 // BLOCKS), r)], np.uint8)
_FILTER_BITS = 20
#: Fingerprints that are looked up at a time.
_CHUNK = 1 << 15


def words(text: str) -> np.ndarray:
    """Hashes of the words of a text."""
    return ALPHANUMERIC(text.lower().encode("utf-8", "replace"))


def fingerprints(found: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of ``size`` shingles; bit by bit, so some 30 bytes a shingle are held at a time."""
    mixed = mix(found)
    out = np.zeros(len(found) - size + 1, np.uint64)
    sums = np.zeros(len(found) + 1, np.int64)
    for bit in range(64):
        np.cumsum((mixed >> np.uint64(bit)) & np.uint64(1), out=sums[1:], dtype=np.int64)
        out |= (2 * (sums[size:] - sums[:-size]) > size).astype(np.uint64) << np.uint64(bit)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two lists of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    common = sum((x & y).values())
    return common / (len(a) + len(b) - common) if common else 0.0


def window_similarities(region: np.ndarray, width: int, places: np.ndarray, item: np.ndarray) -> np.ndarray:
    """``similarity`` of an item and the windows of ``width`` shingles at ``places``, which rise: from one to the next the counts change only by what leaves and enters."""
    known, counts = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(known, region), len(known) - 1)
    at = np.where(known[at] == region, at, -1)
    most, have = counts.tolist(), [0] * len(known)
    common, low, high = 0, int(places[0]), int(places[0])
    out = np.zeros(len(places))
    for k, place in enumerate(places.tolist()):
        if place >= high:  # nothing of the last window is left
            have, common, low, high = [0] * len(known), 0, place, place
        for x in at[low:place].tolist():
            if x >= 0:
                have[x] -= 1
                common -= have[x] < most[x]
        for x in at[high : place + width].tolist():
            if x >= 0:
                common += have[x] < most[x]
                have[x] += 1
        low, high = place, place + width
        out[k] = common / (width + len(item) - common)
    return out


@dataclass
class Index:
    """The items of one block of the benchmark."""

    items: list[tuple[int, np.ndarray]]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(s) for _, s in self.items], np.int64)
        self.prints = np.array([fingerprints(s, len(s))[0] for _, s in self.items], np.uint64)
        self.known = distinct(np.concatenate([s for _, s in self.items])) if self.items else np.zeros(0, np.uint64)
        owned = sorted((x, len(s)) for _, s in self.items for x in s.tolist())
        self.owned = np.array([x for x, _ in owned], np.uint64)
        self.owner_size = np.array([size for _, size in owned], np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - _FILTER_BITS)] = True
        self.largest = int(self.sizes.max()) if self.items else 0
        #: By size: by block, the values within the ball of an item's block, sorted, and whose they are.
        self.balls: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size in sorted(set(self.sizes.tolist())):
            own = np.flatnonzero(self.sizes == size).astype(np.int32)
            self.balls[size] = []
            for block in range(BLOCKS):
                near = (self._block(self.prints[own], block)[:, None] ^ _BALL[None, :]).ravel()
                order = np.argsort(near, kind="stable")
                self.balls[size].append((near[order], np.repeat(own, len(_BALL))[order]))

    @staticmethod
    def _block(prints: np.ndarray, block: int) -> np.ndarray:
        return (prints >> np.uint64(64 // BLOCKS * block)).astype(np.uint8)

    def shared(self, found: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.filter[found >> np.uint64(64 - _FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.known, found[at]), len(self.known) - 1)
        return at[self.known[place] == found[at]]

    def near(self, prints: np.ndarray, size: int) -> dict[int, np.ndarray]:
        """By item of that size the rising positions of all fingerprints within the radius of its own."""
        keys = []
        for start in range(0, len(prints), _CHUNK):
            part, found = prints[start : start + _CHUNK], []
            for block, (values, items) in enumerate(self.balls[size]):
                own = self._block(part, block)
                low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                count = high - low
                at = np.repeat(np.arange(len(own)), count)
                item = items[np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
                close = np.bitwise_count(part[at] ^ self.prints[item]) <= RADIUS
                found.append(item[close].astype(np.int64) * len(prints) + at[close] + start)
            keys.append(np.unique(np.concatenate(found)))
        keys = np.sort(np.concatenate(keys))
        item, first = np.unique(keys // len(prints), return_index=True)
        return {int(i): own % len(prints) for i, own in zip(item, np.split(keys, first[1:]), strict=True)} if len(keys) else {}

    def matches(self, found: np.ndarray, length: int = WORDS) -> dict[int, tuple[float, int, int]]:
        """The best similarity, and the first window (words from, to) that has it, by item; a shingle has ``length`` words."""
        best: dict[int, tuple[float, int, int]] = {}
        hits = self.shared(found)
        if not len(hits):
            return best
        breaks = np.flatnonzero(np.diff(hits) > self.largest) + 1
        for part in np.split(hits, breaks):
            low, high = max(0, int(part[0]) - self.largest + 1), min(len(found), int(part[-1]) + self.largest)
            region = found[low:high]
            own = distinct(found[part])  # a window can only match an item of its size that has one of these
            ends = zip(np.searchsorted(self.owned, own, "left"), np.searchsorted(self.owned, own, "right"), strict=True)
            for size in sorted({size for a, b in ends for size in self.owner_size[a:b].tolist()}):
                width = min(size, len(region))  # a document shorter than the item is one window
                if width < size and len(region) < len(found):
                    continue
                for item, places in self.near(fingerprints(region, width), size).items():
                    scores = window_similarities(region, width, places, self.items[item][1])
                    k = int(scores.argmax())  # the first of equals
                    score, at = float(scores[k]), int(places[k])
                    if score >= SIMILARITY and (item not in best or score > best[item][0]):
                        best[item] = (score, low + at, low + at + width + length - 1)
        return best


    def best_by_id(self, found: np.ndarray, length: int = WORDS) -> list[tuple]:
        """``item_id, similarity, first_word, end_word`` of the best window of each item id, over all its texts."""
        best: dict[int, tuple[float, int, int]] = {}
        for item, (score, first, end) in self.matches(found, length).items():
            name = self.items[item][0]
            if name not in best or (-score, first, end) < (-best[name][0], *best[name][1:]):
                best[name] = (score, first, end)
        return [(name, *x) for name, x in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of bounded size, all texts of an item in one; items that are null or have no words are left out."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // BLOCK_BYTES)
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield Index([(r["item_id"], shingles(w)) for r in own if len(w := words(r["text"]))])


def _passes(benchmark: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """Each block of the benchmark as a broadcast, and whether it is the last; a block is released when the next one is asked for, so its pass has to be written by then."""
    blocks = _blocks(benchmark)
    now = next(blocks, None)
    while now is not None:
        following = next(blocks, None)
        shipped = benchmark.sparkSession.sparkContext.broadcast(now)
        yield shipped, following is None
        if following is not None:
            shipped.destroy()
        now = following


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, end_word``: the best window of each item in each row of ``docs`` that has one.

    Null texts and those without words match nothing. A text or an item of fewer than five words is one shingle, so it
    matches only one of the very same words. Repeated rows give repeated results, a row without id a null ``doc_id``;
    of windows equally near an item the first counts.
    """
    schema = "doc_id long, item_id long, similarity double, first_word long, end_word long"
    result = None
    for shipped, is_last in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in slices(batches):
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text and index.items and len(w := words(text)):
                        rows += [(doc, *x) for x in index.best_by_id(shingles(w), min(WORDS, len(w)))]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "end_word"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        found = found if is_last else materialize(found, "contaminated")
        result = found if result is None else result.unionByName(found)
    return result if result is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold an item; rows without id are judged by their text alone and stay or go with it."""
    at = docs.columns.index("text")
    kept = docs
    for shipped, is_last in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in slices(batches):
                clean = []
                for text in batch.column(at).to_pylist():
                    w = words(text or "")
                    clean.append(not (len(w) and index.items and index.matches(shingles(w))))
                yield batch.filter(pa.array(clean, pa.bool_()))

        before, kept = kept, kept.mapInArrow(run, docs.schema)
        if not is_last:
            kept = materialize(kept, "kept")
            discard(before)
    return kept


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
