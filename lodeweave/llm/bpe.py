"""Byte-pair encoding and decoding with a pair occurrence index.

Words of many texts are encoded together: the distinct words of a piece of a partition lie end to end in one sequence of
symbols, and an index maps each mergeable pair to all its positions. The ranks that occur are applied in ascending order,
each to its whole list; a merge makes new pairs with its neighbours, which are always of higher rank and are added to
their lists, and positions whose pair is gone meanwhile are passed over. The merges are those of a published vocabulary;
nothing is trained here.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.pieces import LATIN, LATIN_LETTER, LETTER, Remembered, after_letter, batched, cut, gather, raw_bytes
from lodeweave.llm.text import slices

#: How the vocabulary's texts are cut into words (fixed by its published format).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Pieces that are one word for certain.
_ONE_WORD = re.compile("(?: ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?]|\n)")
#: Bytes of text that are encoded together, and distinct pieces whose ids a task remembers.
TOGETHER, REMEMBERED = 1 << 20, 150_000
#: Lists of fewer positions are walked through, longer ones are merged as arrays.
SHORT = 24
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[33:127] = True


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Bytes where a word begins for certain: at a blank before a letter, at a mark behind one, around a single line feed."""
    letter = LETTER[raw]
    letter[:-1] |= (raw[:-1] == LATIN) & LATIN_LETTER[raw[1:]]
    out = _MARK[raw] & after_letter(raw)
    out[:-1] |= (raw[:-1] == ord(" ")) & letter[1:]
    broken = np.zeros(len(raw), bool)
    broken[1:] = (raw[1:] == ord("\n")) & _PRINTED[raw[:-1]]
    out |= broken
    out[1:] |= broken[:-1] & letter[1:]
    return out


def byte_characters() -> dict[int, str]:
    """The character by which the vocabulary writes each byte: printable ones as they are, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks and ids of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids: dict[str, int] = spec["model"]["vocab"]
        chars = byte_characters()
        self.first = np.array([ids[chars[b]] for b in range(256)], np.int64)
        self.left, self.right, self.made = [], [], []
        self.rank: dict[int, int] = {}  # by left id * 2**32 + right id
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[(ids[a] << 32) | ids[b]] = rank
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.made.append(ids[a + b])
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in chars.items()}
        self.bytes: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """Words of a text; a special token's string is one word."""
        if self.split is None or not any(s in text for s in self.special):
            return WORD.findall(text)
        return [w for part in self.split.split(text) for w in ([part] if part in self.special else WORD.findall(part))]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 for those that are never merged."""
        key = (left << 32) | right
        near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[near] == key, self.key_ranks[near], -1)

    def merge(self, symbols: np.ndarray, following: np.ndarray, before: np.ndarray) -> None:
        """Apply all merges, in place, to words whose symbols are linked both ways; a symbol that is merged into one before it becomes -1."""
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, at: np.ndarray) -> None:
            hit = np.flatnonzero(ranks >= 0)
            if not len(hit):
                return
            order = hit[np.argsort(ranks[hit], kind="stable")]
            ranks, at = ranks[order], at[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for r, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(at[a:b])

        paired = np.flatnonzero(following >= 0)
        add(self._ranks(symbols[paired], symbols[following[paired]]), paired)
        symbol, after, prior, rank = memoryview(symbols), memoryview(following), memoryview(before), self.rank.get
        while active:
            now = heapq.heappop(active)
            left, right, made = self.left[now], self.right[now], self.made[now]
            lists = places.pop(now)
            own = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            if len(own) < SHORT:
                for i in own.tolist():
                    if symbol[i] != left or (j := after[i]) < 0 or symbol[j] != right:
                        continue  # merged into another symbol meanwhile
                    symbol[i], symbol[j] = made, -1
                    k = after[i] = after[j]
                    near = [(i, made << 32 | symbol[k])] if k >= 0 else []
                    if k >= 0:
                        prior[k] = i
                    if (h := prior[i]) >= 0:
                        near.append((h, symbol[h] << 32 | made))
                    for at, pair in near:
                        if (r := rank(pair)) is not None:
                            if r not in places:
                                places[r] = []
                                heapq.heappush(active, r)
                            places[r].append(np.array([at]))
                continue
            own = own[symbols[own] == left]
            second = following[own]
            good = (second >= 0) & (symbols[second] == right)
            own, second = own[good], second[good]
            if left == right and len(own):  # of overlapping pairs the first counts
                number = np.arange(len(own))
                chained = np.concatenate([[False], own[1:] == second[:-1]])
                good = (number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0
                own, second = own[good], second[good]
            symbols[own], symbols[second] = made, -1
            third = following[own] = following[second]
            some = third >= 0
            before[third[some]] = own[some]
            add(self._ranks(np.full(some.sum(), made), symbols[third[some]]), own[some])
            first = before[own]
            first = first[first >= 0]
            add(self._ranks(symbols[first], np.full(len(first), made)), first)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, merged over all of them at once, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        following, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        following[ends - 1] = -1
        before[ends - size] = -1
        self.merge(symbols, following, before)
        kept = np.concatenate([[0], np.cumsum(symbols >= 0)])
        return symbols[symbols >= 0].astype(np.int32), kept[ends] - kept[ends - size]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of text, each of whole words, end to end, and how many each has."""
        own = [[p] if _ONE_WORD.fullmatch(t := p.decode()) else [w.encode() for w in self.words(t)] for p in pieces]
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(w, len(number)) for words in own for w in words], np.int64)
        plain = [w for w in number if w.decode() not in self.special] if self.special else list(number)
        flat, length = self.encode_words(plain)
        if len(plain) < len(number):
            flat = np.concatenate([flat, np.array(list(self.special.values()), np.int32)])
            sizes = dict(zip(plain, length.tolist(), strict=True))
            starts = dict(zip(plain, (np.cumsum(length) - length).tolist(), strict=True))
            first = len(flat) - len(self.special)
            for k, text in enumerate(self.special):
                sizes[text.encode()], starts[text.encode()] = 1, first + k
            start, length = np.array([starts[w] for w in number], np.int64), np.array([sizes[w] for w in number], np.int64)
        else:
            start = np.cumsum(length) - length
        ids, ends = gather(flat, start, length, which)
        ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, own)])]
        return ids, np.diff(ends)


class Encoder:
    """Ids of texts, each distinct piece encoded once, and texts of ids."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.remembered = Remembered(self.vocabulary.encode_pieces, REMEMBERED)
        known = self.vocabulary.bytes
        table = [known.get(i, b"") for i in range(max(known) + 1)]
        self.length = np.array([len(x) for x in table] + [0], np.int64)  # the last stands for ids that the vocabulary lacks
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def encode(self, texts: pa.Array) -> Iterator[tuple[slice, pa.ListArray]]:
        """Ids of the texts of each slice."""
        for rows in batched(texts, TOGETHER):
            part = texts[rows]
            raw, bounds = raw_bytes(part)
            starts = word_starts(raw)
            for special in self.vocabulary.special:  # a text that holds one is a piece of its own
                for k in np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring(part, special), False))).tolist():
                    starts[bounds[k] : bounds[k + 1]] = False
            pieces, which, first = cut(raw, bounds, starts)
            ids, ends = self.remembered.values(pieces, which)
            ends = np.concatenate([[0], ends])[first]
            yield rows, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))

    def rest(self) -> None:
        """Give memory back at the end of a task: the worker may serve other stages next."""
        self.remembered.forget()
        pa.default_memory_pool().release_unused()

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids; a null list is empty."""
        lists = pc.fill_null(lists, [])
        ids = np.asarray(pc.fill_null(lists.flatten(), -1))
        none = len(self.length) - 1
        data, ends = gather(self.flat, self.start, self.length, np.where((ids >= 0) & (ids < none), ids, none))
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])].tolist()
        data = data.tobytes()
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)], pa.string())


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` (array of int) for each row of ``docs``; a null or empty text has no ids.

    Strings of special tokens in a text become their ids, no others are added, and nothing is cut or padded.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for rows, ids in own.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], ids], names=["doc_id", "ids"])
        own.rest()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, text`` for each row of ``encoded``; ids that the vocabulary lacks give nothing, broken characters U+FFFD."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode(batch.column(1))], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, text``: ``decode`` of ``encode``, in one pass and one Python worker."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for rows, ids in own.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], ids, own.decode(ids)], names=["doc_id", "ids", "text"])
        own.rest()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row."""
    return round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: what the tokenizer makes of every document."""
    return digests(docs)
