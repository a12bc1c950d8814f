"""Document fingerprints after I-Match, over several randomised lexicons.

The lexicon holds the terms whose share of documents lies in a band: neither so rare that an edit makes them up, nor so
common that they say nothing. The fingerprint has one hash for the whole lexicon and one for each random part of it, each
over the document's sorted distinct terms in that part. Parts come in halving sizes, more of the small ones, so that texts
of any length have parts with one or a few of their terms, which an edit elsewhere leaves alone. The likeness of two
fingerprints is the share of hashes that agree among the parts that are not empty in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators.materialize import materialize

#: Band of document frequency, as shares of all documents. A term has at least the lower share, so there are at most
#: (mean distinct terms of a document) / LOW_SHARE of them: the bound of the broadcast lexicon.
LOW_SHARE, HIGH_SHARE = 0.002, 0.1
#: How many parts hold 1 / 2**level of the lexicon each; those of one level have no term in common.
PARTS = {4: 2, 5: 4, 6: 8, 7: 8, 8: 16, 9: 16}
#: Quantiles of the ids between which ranges are cut evenly.
KNOTS = 128


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, low: float = LOW_SHARE, high: float = HIGH_SHARE) -> DataFrame:
    """``term`` (32-bit hash; terms of equal hash are one term) of every term in the band, counted over all rows with a text."""
    solid = docs.where("text IS NOT NULL")
    total = solid.count()
    counts = solid.select(F.explode(terms(F.col("text"))).alias("t")).select(F.hash("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.where((F.col("n") >= low * total) & (F.col("n") <= high * total)).select("term"), "lexicon")


def slot_codes(found: Column) -> Column:
    """Slot and term, packed into one number, sorted: slot 0 holds each of the terms, and bits of a term's hash say which parts it is in."""
    hashed = F.transform(found, lambda t: F.struct(t.cast("bigint").bitwiseAND((1 << 32) - 1).alias("t"), F.xxhash64(t).alias("h")))

    def codes(s: Column) -> Column:
        out, first, shift = [s["t"]], 1, 0
        for level, parts in PARTS.items():
            field = F.shiftrightunsigned(s["h"], shift).bitwiseAND((1 << level) - 1)
            out.append(F.when(field < parts, F.shiftleft(field + first, 32).bitwiseOR(s["t"])))
            first, shift = first + parts, shift + level
        return F.array_compact(F.array(*out))

    return F.array_sort(F.flatten(F.transform(hashed, codes)))


def part_hashes(found: Column) -> Column:
    """Slot and 32-bit hash of its sorted terms, packed into one number, of each part that is not empty, from a document's terms of the lexicon."""
    low = (1 << 32) - 1
    none = F.array().cast("array<bigint>")
    packed = lambda acc: F.shiftleft(acc["slot"], 32).bitwiseOR(acc["h"].bitwiseAND(low))
    state = lambda done, slot, h: F.struct(done.alias("done"), slot.alias("slot"), h.alias("h"))

    def add(acc: Column, code: Column) -> Column:
        slot = F.shiftright(code, 32)
        grown = F.when(acc["slot"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(packed(acc))))
        return F.when(acc["slot"] == slot, state(acc["done"], slot, F.xxhash64(acc["h"], code))).otherwise(state(grown, slot, F.xxhash64(code)))

    start = state(none, F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(F.size(found) > 0, F.aggregate(slot_codes(found), start, add, lambda acc: F.concat(acc["done"], F.array(packed(acc))))).otherwise(none)


def fingerprint(parts: Column, text_hash: Column) -> Column:
    """Ten digits for each part that is not empty; where all are, from a hash of the text."""
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: F.lower(F.lpad(F.hex(p), 10, "0"))), "")).otherwise(F.concat(F.lit("t"), F.hex(text_hash)))


def likeness(a: Column, a_parts: Column, b: Column, b_parts: Column) -> Column:
    """Share of agreeing parts among those that are not empty in both; 1 for equal fingerprints, 0 for unlike kinds."""
    slots = lambda parts: F.transform(parts, lambda p: F.shiftright(p, 32))
    either = F.size(F.array_union(slots(a_parts), slots(b_parts)))
    both = (F.size(a_parts) > 0) & (F.size(b_parts) > 0)
    return F.when(a == b, 1.0).when(both, F.size(F.array_intersect(a_parts, b_parts)) / either).otherwise(0.0)


def _range_of(rows: DataFrame, buckets: int) -> Column:
    """A number that grows with the id: between neighbouring quantiles of the ids (``KNOTS``) equal widths; -1 for a null id."""
    parts = min(KNOTS, buckets)
    knots = sorted({int(x) for x in rows.approxQuantile("doc_id", [k / parts for k in range(parts + 1)], 0.2 / parts)})
    if not knots:
        return F.lit(-1).cast("long")
    each = max(1, buckets // parts)

    def within(k: int) -> Column:
        width = max(1, (knots[k + 1] - knots[k]) // each if k + 1 < len(knots) else 1)
        place = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(str(knots[k])).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)"))
        return F.lit(k * (each + 1)) + F.least(F.greatest(place, F.lit(0)), F.lit(each)).cast("long")

    def search(low: int, high: int) -> Column:
        if high - low == 1:
            return within(low)
        middle = (low + high) // 2
        return F.when(F.col("doc_id") >= F.lit(knots[middle]), search(middle, high)).otherwise(search(low, middle))

    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(search(0, len(knots))).cast("long")


def with_next(rows: DataFrame, value: str, bucket_rows: int = 2000, most_buckets: int = 1 << 16) -> DataFrame:
    """``rows`` (``doc_id, tie`` and others) with ``next``: ``value`` of the next row in descending order of id, after the last the first.

    Ranges of ids, cut by quantiles, are windows of their own; each also gets a copy of the first row of the range below, found through a
    table with one row for each range (``most_buckets`` at most). A null id comes last, equal ids in order of ``tie``.
    """
    buckets = max(1, min(most_buckets, rows.count() // bucket_rows))
    keyed = rows.withColumn("bucket", _range_of(rows, buckets))
    order = Window.orderBy(F.desc("bucket"))
    tops = keyed.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    goes_to = F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(Window.partitionBy()))  # the lowest range is followed by the highest
    tops = materialize(tops.select(F.col("bucket").alias("came_from"), "top", goes_to.alias("goes_to")), "ranges")
    first = keyed.join(F.broadcast(tops), (F.col("bucket") == F.col("came_from")) & F.col("doc_id").eqNullSafe(F.col("top")))
    guests = first.select(*[c for c in keyed.columns if c != "bucket"], F.col("goes_to").alias("bucket"), F.lit(1).alias("guest"))
    window = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie")
    both = keyed.withColumn("guest", F.lit(0)).unionByName(guests)
    return both.withColumn("next", F.lead(value).over(window)).where("guest = 0").drop("guest", "bucket")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row of ``docs``.

    The last third of an edited text is the beginning of the next document in descending order of id. A null text is
    empty; texts without terms of the lexicon are alike only if they are equal but for case. Of repeated rows each one
    is the next of the other.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    pairs = with_next(docs.withColumn("tie", F.xxhash64("text")), "text").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "tie", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - third), F.substring("next", F.lit(1), third)).alias("edited"),
    )
    key = F.struct("row", "doc_id", "tie", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.xxhash64(F.lower("text")).alias("plain"), F.xxhash64(F.lower("edited")).alias("edited_plain"))
    sides = F.array(F.struct(F.lit(False).alias("edit"), F.col("text").alias("text")), F.struct(F.lit(True).alias("edit"), F.col("edited").alias("text")))
    sided = pairs.select(key.alias("key"), F.explode(sides).alias("s"))
    spread = sided.select("key", "s.edit", F.posexplode_outer(terms(F.col("s.text"))).alias("at", "t"))
    spread = spread.select("key", "edit", F.hash("t").alias("term"), F.coalesce(F.col("at") == 0, F.lit(True)).alias("head"))
    # one row for each side stays even if no term is in the lexicon
    found = spread.join(F.broadcast(known.withColumn("known", F.lit(True))), "term", "left").where("known OR head")
    own = F.collect_set(F.when(F.col("known") & ~F.col("edit"), F.col("term")))
    edited = F.collect_set(F.when(F.col("known") & F.col("edit"), F.col("term")))
    terms_of = found.groupBy("key").agg(own.alias("own"), edited.alias("edited")).select("key.*", "own", "edited")
    parts_of = terms_of.select(
        "doc_id", "tie", "n_chars", "sha", F.struct("plain", part_hashes(F.col("own")).alias("parts")).alias("mark"), F.struct(F.col("edited_plain").alias("plain"), part_hashes(F.col("edited")).alias("parts")).alias("edit"),
    )
    result = with_next(materialize(parts_of, "fingerprints"), "mark")
    shown = result.select("doc_id", "n_chars", "sha", *[F.struct(fingerprint(F.col(f"{c}.parts"), F.col(f"{c}.plain")).alias("print"), F.col(f"{c}.parts").alias("parts")).alias(c) for c in ("mark", "edit", "next")])
    near = lambda other: likeness(F.col("mark.print"), F.col("mark.parts"), F.col(f"{other}.print"), F.col(f"{other}.parts"))
    return shown.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.col("mark.print").alias("fingerprint"), F.col("edit.print").alias("edited_fingerprint"),
        near("edit").alias("near_edited"), near("next").alias("near_next"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
