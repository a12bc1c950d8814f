"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record is the length of its payload (8 bytes, little-endian), the masked checksum of those 8 bytes (4), the payload,
its masked checksum (4) and one line feed. The payload is a flag for a missing id (1), the width of an id in bytes (1),
the document's id (8) and the token ids. A checksum is crc32, masked so that a checksum over checksums is no fixed
point. Records lie in ascending order of doc_id, within a file and from file to file. The index is a table of its own:
``file, offset, length, doc_id, n_tokens, start``, where ``start`` counts the tokens of all records before.

Spark writes the files through its text writer (the line feed ends each row), so they are committed like any table and
can lie in any store that Spark reaches.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeweave.llm.pieces import Remembered, after_letter, batched, cut, gather, raw_bytes
from lodeweave.operators.materialize import materialize, scratch_path

END = 2
#: Text that goes into one file, in bytes; a reader holds one file at a time.
FILE_BYTES = 24 << 20
#: Files whose token counts are summed up in one task.
FILES = 4096
_HEAD, _BODY = struct.Struct("<Q"), struct.Struct("<BBq")
_CRC = struct.Struct("<I")
#: Letters that Unicode normalisation leaves alone: the tokenizer never cuts between them.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks before which the tokenizer always cuts if such a letter precedes.
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?*#$%&")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \n")] = True


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = _BODY.pack(doc_id is None, width, doc_id or 0) + ids
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CRC.pack(masked(head)), payload, _CRC.pack(masked(payload)), b"\n"))


def frames(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each record of a file; a damaged one raises."""
    at = 0
    while at < len(content):
        head = content[at : at + 8]
        (size,) = _HEAD.unpack(head)
        payload = content[at + 12 : at + 12 + size]
        if content[at + 8 : at + 12] != _CRC.pack(masked(head)) or content[at + 12 + size : at + 16 + size] != _CRC.pack(masked(payload)):
            raise ValueError(f"damaged record at byte {at}")
        missing, width, doc_id = _BODY.unpack_from(payload)
        yield at, size + 17, None if missing else doc_id, np.frombuffer(payload, f"<u{width}", offset=_BODY.size)
        at += size + 17


def heads(content: bytes) -> Iterator[tuple[int, int, int | None, int]]:
    """(offset, length, doc_id, number of ids) of each record, from the frames alone."""
    at = 0
    while at < len(content):
        (size,) = _HEAD.unpack_from(content, at)
        if content[at + 8 : at + 12] != _CRC.pack(masked(content[at : at + 8])):
            raise ValueError(f"damaged record at byte {at}")
        missing, width, doc_id = _BODY.unpack_from(content, at + 12)
        yield at, size + 17, None if missing else doc_id, (size - _BODY.size) // width
        at += size + 17


class Encoder:
    """The tokenizer over pieces of text, each distinct one once; it never joins text across a blank, nor a letter and a mark."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.remembered = Remembered(self._encode)

    def _encode(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has: words of letters many in one text, each up to its token that ends a word."""
        pieces = [p.decode() for p in found]
        words = [i for i, p in enumerate(pieces) if _WORD.fullmatch(p)]
        length = np.zeros(len(pieces), np.int64)
        own: list[np.ndarray] = [np.zeros(0, self.kind)]
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([pieces[i] for i in part])], add_special_tokens=False)[0].ids, self.kind)
            length[part] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            own.append(ids)
        order = np.array(words, np.int64)
        others = np.setdiff1d(np.arange(len(pieces)), order, assume_unique=True)
        for at in range(0, len(others), 1000):
            part = others[at : at + 1000].tolist()
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)]
            length[part] = [len(ids) for ids in encoded]
            own.append(np.array([i for ids in encoded for i in ids], self.kind))
        order = np.concatenate([order, others])
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(length[order]) - length[order]
        return gather(np.concatenate(own), start, length, np.arange(len(pieces)))[0], length

    def __call__(self, texts: pa.Array) -> Iterator[tuple[slice, list[bytes]]]:
        """Ids of the texts of each slice as bytes, without the end id."""
        for rows in batched(texts):
            raw, bounds = raw_bytes(texts[rows])
            pieces, which, first = cut(raw, bounds, _MARK[raw] & after_letter(raw), _BLANK[raw])
            ids, ends = self.remembered.values(pieces, which)
            ends = np.concatenate([[0], ends])[first] * self.width
            data = ids.astype(self.kind).tobytes()
            yield rows, [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = END) -> None:
    """Write the token ids of every row of ``docs`` to ``path``; a null or empty text has the end id only."""
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    files = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tail = b"" if end is None else np.array([end], f"<u{encode.width}").tobytes()
        for batch in batches:
            for rows, found in encode(batch.column(1)):
                out = [frame(i, ids + tail, encode.width)[:-1] for i, ids in zip(batch.column(0)[rows].to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _scan(spark: SparkSession, path: str, schema: str, rows_of: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """``file`` and what ``rows_of`` finds in its bytes; one file at a time is in a task's memory."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = ((file, *r) for r in rows_of(content.as_buffer().to_pybytes()))
                while part := list(islice(rows, 2000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), types, strict=True)], names=names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content").mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``file, offset, doc_id, ids_crc32`` and ``ids`` (binary, 32 bits each) of all records, their checksums verified."""

    def rows_of(content: bytes) -> Iterator[tuple]:
        for offset, _, doc_id, ids in frames(content):
            wide = ids.astype("<u4").tobytes()
            yield (offset, doc_id, zlib.crc32(wide), wide) if with_ids else (offset, doc_id, zlib.crc32(wide))

    return _scan(spark, path, "file string, offset long, doc_id long, ids_crc32 long" + ", ids binary" * with_ids, rows_of)


def with_start(records: DataFrame) -> DataFrame:
    """``records`` with ``start``: the number in a file's name tells its place, so one row for each file is summed up in order.

    Sums run within blocks of ``FILES`` files and over one row for each block.
    """
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    totals = records.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumn("number", number).withColumn("block", F.floor(F.col("number") / FILES))
    before = lambda window, value: F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("block").agg(F.sum("total").alias("total")).select("block", before(Window.orderBy("block"), "total").alias("sum_before"))
    within = totals.select("file", "block", before(Window.partitionBy("block").orderBy("number"), "total").alias("within"))
    base = within.join(blocks, "block").select("file", (F.col("within") + F.col("sum_before")).alias("base"))
    return records.join(base, "file").withColumn("start", F.col("base") + F.col("before"))


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Write the offset index of the records in ``path``, as Parquet."""

    def rows_of(content: bytes) -> Iterator[tuple]:
        before = 0
        for offset, length, doc_id, count in heads(content):
            yield offset, length, doc_id, count, before
            before += count

    rows = materialize(_scan(spark, path, "file string, offset long, length long, doc_id long, n_tokens long, before long", rows_of), "heads")
    with_start(rows).select("file", "offset", "length", "doc_id", "n_tokens", "start").write.parquet(index_path)


def read_at(spark: SparkSession, path: str, index: DataFrame, with_ids: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, in whatever order a shuffled reader wants them."""
    return index.join(read_records(spark, path, with_ids).drop("doc_id"), ["file", "offset"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files and their index."""
    path = scratch_path(spark, "records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    write_index(spark, path, f"{path}.index")
    return read_at(spark, path, spark.read.parquet(f"{path}.index"), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
