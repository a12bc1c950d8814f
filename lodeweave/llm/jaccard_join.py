"""Grouped prefix join on word shingles with a Jaccard threshold, and the components of its links.

A document is the set of its distinct 5-word shingles; equal sets are one set from then on. All sets are sorted by one
order: rare shingles by hash, then the frequent ones by document frequency. Sets that reach the threshold must share a
shingle among their first n - ceil(0.8 n) + 1 ones, their prefixes. Sets with the same prefix and size form a group, and
the join works on groups: each shingle lists the groups with it in their prefix, pairs of groups are filtered by size
and position, then the pairs are expanded into sets and the sets compared in full.

Not all pairs inside a large class of near copies are compared. Round one compares the first set of each size class in a
shingle's list with the others of the class, and the sets of one group as a chain; components of those links follow. Further rounds
compare the sets outside a list's main component with a few members of it, as long as many pairs are open; the last one
compares every remaining pair of a list whose two sets are in different components. A pair that is never compared is thus one whose
two sets are linked already, so the components are those of the full join.

Before texts are fetched, each pair passes a bound: a set has a bitmap, in which each shingle turns one bit over, and two
bitmaps differ in no more bits than the sets differ in shingles. Only pairs near enough by that bound are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.text import SPACED, distinct, shingles, slices
from lodeweave.operators.components import connected_components
from lodeweave.operators.materialize import discard, materialize

#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 80, 100
#: Shingles in fewer documents count as rare; at most so many frequent ones are told apart, which bounds their broadcast to 4 MB.
FREQUENT, MOST_FREQUENT = 32, 1 << 18
#: Document frequencies are counted in 2**32 counters, 2**20 of them in one slot.
LOW_BITS, FLUSH = 20, 1 << 21
#: While more than ``FEW`` pairs for each set may be open, but ``MOST_ROUNDS`` times at most, the sets outside a list's main
#: component are compared with so many delegates of it; then all pairs that are still open are compared.
FEW, DELEGATES, MOST_ROUNDS = 2, 32, 1
#: 64-bit words of the id filter that texts pass before they are shuffled: a bit in sixteen is set, up to 8 MB of them.
LEAST_FILTER, MOST_FILTER = 1 << 10, 1 << 20


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z count as a-z, and words end at ASCII white space."""
    return distinct(shingles(SPACED(text)))


def _binary(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


# document frequencies


def _count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters hit by the shingles of a task, as one row for each slot: how many in each sixteenth of it, then 16 bits of each."""
    held: list[np.ndarray] = []
    size = 0

    def packed() -> pa.RecordBatch:
        ids = np.sort(np.concatenate(held))
        part = np.bincount(ids >> np.uint32(16), minlength=1 << 16).astype(np.uint32).reshape(-1, 16)
        ends = np.cumsum(part.sum(1))
        low = (ids & np.uint32(0xFFFF)).astype(np.uint16)
        slots = np.flatnonzero(part.sum(1))
        blobs = [part[s].tobytes() + low[ends[s] - part[s].sum() : ends[s]].tobytes() for s in slots]
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(blobs, pa.binary())], names=["slot", "ids"])

    for batch in slices(batches):
        for text in _binary(batch.column(0)):
            if text:
                found = (shingle_set(text) >> np.uint64(32)).astype(np.uint32)
                held.append(found)
                size += len(found)
                if size >= FLUSH:
                    yield packed()
                    held, size = [], 0
    if size:
        yield packed()


def _count_reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of at least ``FREQUENT``; rows come sorted by slot and one slot's counters are held at a time."""
    counts = np.zeros(1 << LOW_BITS, np.int64)
    at, held, size = None, [], 0

    def add() -> None:
        nonlocal held, size
        if held:
            counts[:] += np.bincount(np.concatenate(held), minlength=1 << LOW_BITS)
        held, size = [], 0

    def found() -> pa.RecordBatch:
        add()
        ids = np.flatnonzero(counts >= FREQUENT)
        return pa.RecordBatch.from_arrays([pa.array(ids + (at << LOW_BITS), pa.int64()), pa.array(counts[ids], pa.int64())], names=["counter", "n"])

    for batch in batches:
        for slot, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if slot != at:
                if at is not None:
                    yield found()
                counts[:] = 0
                at = slot
            part = np.frombuffer(blob, np.uint32, 16)
            low = np.frombuffer(blob, np.uint16, offset=64)
            held.append(low.astype(np.int64) + (np.repeat(np.arange(16), part) << 16))
            size += len(low)
            if size >= FLUSH:
                add()
    if at is not None:
        yield found()


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent counters, sorted, and their document frequencies over all documents; at most ``MOST_FREQUENT``.

    Only the order of shingles depends on this, never which pairs are links.
    """
    rows = docs.select("text").mapInArrow(_count_map, "slot int, ids binary").repartition("slot").sortWithinPartitions("slot")
    top = rows.mapInArrow(_count_reduce, "counter long, n long").orderBy(F.desc("n"), "counter").limit(MOST_FREQUENT).toArrow()
    ids, n = (np.asarray(top.column(c)).astype(np.uint64) for c in ("counter", "n"))
    order = np.argsort(ids)
    return ids[order], n[order]


# prefixes and groups


def prefix_length(n: int) -> int:
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def least_overlap(a: Column, b: Column) -> Column:
    """Fewest common shingles of two linked sets of these sizes."""
    return F.ceil((a + b) * NUMERATOR / (NUMERATOR + DENOMINATOR))


def sketches(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, h`` (hash of the text), ``n, sid`` (id of the set), ``gid`` (of its prefix and size), ``prefix, bits``; the last four are null for an empty set."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = shipped.value
        for batch in slices(batches):
            n, sid, gid, prefixes, bits = [], [], [], [], []
            for text in _binary(batch.column(1)):
                own = shingle_set(text or b"")
                n.append(len(own))
                if not len(own):
                    sid.append(None)
                    gid.append(None)
                    prefixes.append(None)
                    bits.append(None)
                    continue
                weight = np.zeros(len(own), np.uint64)
                if len(ids):
                    counter = own >> np.uint64(32)
                    near = np.minimum(np.searchsorted(ids, counter), len(ids) - 1)
                    weight = np.where(ids[near] == counter, counts[near], 0)
                prefix = own[np.lexsort((own, weight))[: prefix_length(len(own))]]
                sid.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                gid.append(xxhash.xxh3_64_intdigest(prefix.tobytes(), len(own)))
                prefixes.append(prefix.view(np.int64))
                bits.append(bitmap(own))
            signed = lambda x: pa.array(x, pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int32()), signed(sid), signed(gid), *(pa.array(x, pa.list_(pa.int64())) for x in (prefixes, bits))], names=["doc_id", "h", "n", "sid", "gid", "prefix", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, n int, sid long, gid long, prefix array<long>, bits array<long>")


def _fits(na: str, pa_: str, nb: str, pb: str) -> Column:
    """Size and position filter for a first common shingle at these positions."""
    a, b = F.col(na), F.col(nb)
    left = F.least(a - F.col(pa_), b - F.col(pb))
    return left >= least_overlap(a, b)


# comparison of whole sets


def bitmap(own: np.ndarray) -> np.ndarray:
    """One bit at least for each shingle of a set, a power of two and 64 or more: whether an odd number of shingles falls on it."""
    size = max(64, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _halved(bits: Column) -> Column:
    """The bitmap of half the size."""
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _may_link(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Whether two bitmaps, of one size or one twice the other, leave room for a link."""
    x, y = F.when(F.size(a) > F.size(b), _halved(a)).otherwise(a), F.when(F.size(b) > F.size(a), _halved(b)).otherwise(b)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    return (F.size(x) != F.size(y)) | (apart * (NUMERATOR + DENOMINATOR) <= (na + nb) * (DENOMINATOR - NUMERATOR))


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the hashes of ids, about sixteen for each id within the limits above."""
    words = min(MOST_FILTER, max(LEAST_FILTER, 1 << (ids.count() // 4).bit_length()))
    slot = F.pmod(F.xxhash64("doc"), F.lit(words * 64))
    rows = ids.select((slot / 64).cast("int").alias("w"), F.expr("shiftleft(1L, int(pmod(xxhash64(doc), 64)))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(words, np.int64)
    out[np.asarray(rows.column("w"))] = np.asarray(rows.column("b"))
    return out.view(np.uint8)


def compare(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those ``pairs`` (``a, b``: set ids; ``doc_a, doc_b``: a document of each) that reach the threshold, as a written table."""
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(F.col("bits_a"), F.col("na"), F.col("bits_b"), F.col("nb")))
    pairs = materialize(near.select("a", "b", "doc_a", "doc_b"), "pairs")
    wanted = pairs.select(F.col("doc_a").alias("doc")).union(pairs.select("doc_b")).distinct()
    kept = _id_filter(wanted)
    size = len(kept) * 8
    bits = docs.sparkSession.sparkContext.broadcast(kept)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            place = np.asarray(batch.column(2))
            hit = (bits.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["doc", "text"]).filter(pa.array(hit.astype(bool)))

    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(size))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text", slot.alias("slot")).mapInArrow(pick, "doc long, text string")
    with_a = pairs.join(texts.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a")
    both = with_a.join(texts.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            keep = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns[:2]), *(_binary(c) for c in batch.columns[2:]), strict=True):
                if len(known) > 256:
                    known.clear()
                for key, text in ((a, ta), (b, tb)):
                    if key not in known:
                        own = shingle_set(text or b"")
                        if np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes()))) == key:
                            known[key] = own
                if a not in known or b not in known:  # another text under the same id; the right one has its own row
                    keep.append(False)
                    continue
                x, y = known[a], known[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = materialize(both.mapInArrow(run, "a long, b long"), "links")
    discard(pairs)
    return found


# the join


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of ``docs``, and links ``a, b`` between sets that give the components of the full join."""
    docs = docs.select("doc_id", "text")
    sketch = materialize(sketches(docs, frequent_shingles(docs)), "sketches")
    full = sketch.where("n > 0 AND doc_id IS NOT NULL")
    sets = materialize(full.groupBy("sid").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("gid").alias("gid"), F.first("bits").alias("bits")), "sets")
    groups = full.groupBy("gid").agg(F.min("n").alias("n"), F.first("prefix").alias("prefix"), F.min("sid").alias("sid"))

    postings = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    # of the sets of one size class the first is compared with the others, and with one of the class below
    postings = postings.withColumn("size_class", F.floor(F.log("n") / float(np.log(DENOMINATOR / NUMERATOR))))
    order = Window.partitionBy("token").orderBy("size_class", "gid")
    posting = F.struct("gid", "n", "pos")
    pivot = F.first(posting).over(Window.partitionBy("token", "size_class").orderBy("gid"))
    listed = postings.withColumns({"before": F.lag(posting).over(order), "more": F.lead("gid").over(order).isNotNull()}).where("before IS NOT NULL OR more")
    listed = listed.withColumn("pivot", pivot).withColumn("p", F.when(F.col("pivot.gid") == F.col("gid"), F.col("before")).otherwise(F.col("pivot")))
    listed = listed.withColumns({"pn": F.col("p.n"), "pp": F.col("p.pos")})
    listed = materialize(listed.select("token", "gid", "n", "pos", F.when(_fits("n", "pos", "pn", "pp"), F.col("p.gid")).alias("prev")), "postings")

    firsts = sets.groupBy("gid").agg(F.min_by("sid", "sid").alias("sid"), F.min_by("doc", "sid").alias("doc"), F.count(F.lit(1)).alias("members"))
    near = listed.where("prev IS NOT NULL AND prev <> gid").select(F.least("gid", "prev").alias("ga"), F.greatest("gid", "prev").alias("gb")).distinct()
    between = (
        near.join(firsts.select(F.col("gid").alias("ga"), F.col("sid").alias("a"), F.col("doc").alias("doc_a")), "ga")
        .join(firsts.select(F.col("gid").alias("gb"), F.col("sid").alias("b"), F.col("doc").alias("doc_b")), "gb")
        .select("a", "b", "doc_a", "doc_b")
    )
    chain = Window.partitionBy("gid").orderBy("sid")
    within = sets.select("sid", "doc", F.lag("sid").over(chain).alias("a"), F.lag("doc").over(chain).alias("doc_a")).where("a IS NOT NULL")
    found = compare(docs, sets, between.unionByName(within.select("a", F.col("sid").alias("b"), "doc_a", F.col("doc").alias("doc_b"))))

    crowded = sets.join(firsts.where("members > 1").select("gid"), "gid", "left_semi").select(F.col("gid").alias("token"), "sid", F.lit(0).alias("pos"))
    lists = listed.select("token", "gid", "pos").join(sets.select("sid", "gid"), "gid").select("token", "sid", "pos").unionByName(crowded)
    size, before = sets.count(), None
    for salt in range(MOST_ROUNDS + 1):
        unsettled, pairs = _unsettled(lists, sets, found)
        last = salt == MOST_ROUNDS or pairs <= FEW * size or (before is not None and pairs > 0.98 * before)
        before = pairs
        more = compare(docs, sets, _remaining(unsettled) if last else _with_delegates(unsettled, salt, DELEGATES ** (salt + 1)))
        known, found = found, materialize(found.unionByName(more), "links")
        discard(unsettled, more, known)
        if last:
            break
    discard(listed, sets)
    return sketch, found


def _unsettled(lists: DataFrame, sets: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """Members of lists that hold several components, with the list's largest one as ``main``; and how many pairs those make at most."""
    member = connected_components(found, "a", "b")
    placed = sets.join(member.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "doc", "n", F.coalesce("component", "sid").alias("c"))
    rows = lists.join(placed, "sid")
    shares = rows.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    several = shares.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("total"), F.max("k").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    several = materialize(several, "lists")
    pairs = several.agg(F.sum(F.col("total") * (F.col("total") - F.col("most")))).first()[0] or 0
    unsettled = materialize(rows.join(several.select("token", "main"), "token"), "unsettled")
    discard(member, several)
    return unsettled, pairs


def _sides(minor: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of members of one list in different components that pass the filters, each once."""
    x = minor.select("token", F.col("sid").alias("a"), F.col("doc").alias("doc_a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("c").alias("ca"))
    y = other.select("token", F.col("sid").alias("b"), F.col("doc").alias("doc_b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("c").alias("cb"), "main")
    pairs = x.join(y, "token").where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & _fits("na", "pa", "nb", "pb"))
    ordered = F.col("a") < F.col("b")
    return pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(ordered, F.col("doc_a")).otherwise(F.col("doc_b")).alias("doc_a"), F.when(ordered, F.col("doc_b")).otherwise(F.col("doc_a")).alias("doc_b"),
    ).distinct()


def _with_delegates(unsettled: DataFrame, salt: int, delegates: int) -> DataFrame:
    """Pairs of the members outside a list's main component with a few members of it, the same few wherever they are listed."""
    order = Window.partitionBy("token").orderBy(F.xxhash64(F.lit(salt), "sid"))
    main = unsettled.where("c = main").withColumn("k", F.row_number().over(order)).where(F.col("k") <= delegates).drop("k")
    return _sides(unsettled.where("c <> main"), main)


def _remaining(unsettled: DataFrame) -> DataFrame:
    """All pairs of members of one list that are in different components: one of each pair is outside the main one."""
    return _sides(unsettled.where("c <> main"), unsettled)


def _placed(docs: DataFrame) -> DataFrame:
    """``doc_id, h, n_shingles, component_id`` for each row of ``docs``."""
    sketch, found = links(docs)
    member = connected_components(found, "a", "b").withColumnRenamed("node", "sid")
    rows = sketch.select("doc_id", "h", "n", "sid").join(member, "sid", "left").select("doc_id", "h", "n", F.coalesce("component", "sid").alias("c"))
    least = rows.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    return rows.join(least, "c", "left").select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), component)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest id among the documents reachable by links. Null and blank texts have no shingles
    and are alone; copies are linked to each other; repeated rows give repeated results; a row without id is alone
    under a null component. Of rows with one id and different texts, each is placed by its own text.
    """
    return _placed(docs).drop("h")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays; rows without id stay. Rows go by id and text."""
    found = _placed(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone"), "h").distinct()
    return docs.join(found, (docs["doc_id"] == found["gone"]) & (F.xxhash64(docs["text"]) == found["h"]), "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS component FROM r GROUP BY a) k ON k.a = d.doc_id
"""
