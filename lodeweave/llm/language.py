"""Language identification with string kernels.

A text is the set of its blended-spectrum n-grams (1 to 4 bytes of its lower-cased letters, hashed to ``DIM`` slots);
the kernel of two texts is the size of the common set over the geometric mean of the sizes. A Nyström map over a
bounded number of landmark texts and one-versus-rest kernel ridge regression give one score for each language. The
landmark kernel is linear in the presence vector, so a batch is scored by one matrix product per block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.text import slices

DIM = 1 << 15
SIZES = (1, 2, 3, 4)
#: Training sample: about so many texts of each of the most frequent languages (4 KB a text on the driver).
PER_LANGUAGE, MOST_LANGUAGES = 300, 100
LANDMARKS = 384
RIDGE = 1e-3
BLOCK = 64
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Slots of the distinct n-grams of a text; runs of other characters than letters count as one blank."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    letter = _LETTER[raw]
    raw = np.where(letter, raw, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    raw = raw[keep].astype(np.uint32)
    seen = np.zeros(DIM, bool)
    code = np.zeros(len(raw), np.uint32)
    for n in SIZES:
        if len(raw) < n:
            break
        code = code[: len(raw) - n + 1] * np.uint32(256) + raw[n - 1 :]
        seen[(code * np.uint32(2654435761) + np.uint32(n * 0x3C6EF372)) >> np.uint32(17)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """``weights``: DIM x languages, to be divided by the root of a text's number of n-grams."""

    languages: list[str]
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its score in [0, 1] for each text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        where = [i for i, t in enumerate(texts) if self.languages and has_letters(t)]
        for at in range(0, len(where), BLOCK):
            rows = where[at : at + BLOCK]
            present = np.zeros((len(rows), DIM), np.float32)
            for k, i in enumerate(rows):
                present[k, grams(texts[i])] = 1
            scores = present @ self.weights / np.sqrt(np.maximum(present.sum(1), 1))[:, None]
            best = scores.argmax(1)
            for k, i in enumerate(rows):
                out[i] = (self.languages[best[k]], float(np.clip(scores[k, best[k]], 0, 1)))
        return out


def train(texts: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression with 0/1 targets over texts given by the slots of their n-grams."""
    pairs = list(zip(texts, languages, strict=True))
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((DIM, 0), np.float32))

    def dense(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), DIM), np.float32)
        for k, i in enumerate(rows):
            out[k, pairs[i][0]] = 1 / np.sqrt(len(pairs[i][0]))
        return out

    y = np.array([[name == lang for name in names] for _, lang in pairs], float)
    by_name = [np.flatnonzero(y[:, k]) for k in range(len(names))]
    share = max(1, landmarks // len(names))
    chosen = np.concatenate([rows[:share] for rows in by_name])
    base = dense(chosen)
    values, vectors = np.linalg.eigh((base @ base.T).astype(float))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    blocks = [dense(np.arange(at, min(at + BLOCK, len(pairs)))) @ base.T for at in range(0, len(pairs), BLOCK)]  # never all texts at once
    z = np.concatenate(blocks) @ whiten
    weight = 1 / np.array([len(by_name[k]) for k in y.argmax(1)])  # each language counts the same
    zw = z * weight[:, None]
    beta = np.linalg.solve(z.T @ zw + ridge * np.eye(z.shape[1]), zw.T @ y)
    return Model(names, (base.T @ (whiten @ beta)).astype(np.float32))


def held_out(doc_id: str = "doc_id"):
    """Whether the third of the ids that training must not see holds this one; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """Train on about ``per_language`` texts of each of the ``most_languages`` most frequent languages, chosen by a hash of the id.

    The sample is bounded by these documented numbers, and a text comes to the driver as a bitmap of its n-grams, so the
    driver holds a few MB at any size of the corpus and of its texts. Rows with null text or language, and texts without
    letters, are not used; of languages with equal scores the first name is predicted.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not counts:
        return train([], [])
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [None if not has_letters(t) else np.packbits(np.bincount(grams(t), minlength=DIM).astype(bool)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["doc_id", "lang", "bits"])

    chosen = rows.where(uniform < share).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(bitmaps, "doc_id long, lang string, bits binary")
    sample = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["lang"], bytes(r["bits"])) for r in chosen.where("bits IS NOT NULL").collect())
    return train([np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))) for *_, bits in sample], [lang for _, _, lang, _ in sample])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``; ``und`` and 0 for a text without letters.

    Repeated rows are judged alike, one row each. Other columns of ``docs`` are not looked at.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in slices(batches):
            found = model.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model can give a language; the others (``und``) go."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in slices(batches):
            kept = pa.array([x[0] != UNKNOWN for x in model.score(batch.column(at).to_pylist())], pa.bool_())
            yield batch.filter(kept)

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs.where(~held_out())))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language cannot be told (no text, no letters) go."""
    return accept(docs, fit(docs.where(~held_out())))
