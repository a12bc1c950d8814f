"""Removal of repeated line runs with a suffix array over line ids.

A document is the sequence of its lines that are not blank. Lines that occur once in the corpus end every repeat, so only
the others become suffixes. Their ranks come from prefix doubling: a rank over one line, then over two, four, ... lines,
each round sorting the distinct pairs (rank, rank of the suffix that many lines further on); the sort numbers the pairs,
so ranks follow the order of the suffixes. Suffixes with a common prefix of m lines are one interval of the suffix
array; with 2**k <= m they are those that agree in rank k and in rank k of the suffix m - 2**k lines on. A run is the
shortest one from its first line that holds ``min_words`` words, and every longer repeat is a chain of such runs, so the
intervals of runs mark all maximal repeats. Of each interval the first occurrence stays and the later copies go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators.materialize import materialize

MIN_WORDS = 10


def _keys() -> list[Column]:
    """A document is known by its id and text; equal rows are one document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t")]


def _lines(docs: DataFrame) -> DataFrame:
    """``d, t, i`` (index among all lines), ``j`` (index among those not blank), ``h, g`` (line id), ``w`` (words)."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    solid = docs.where("text IS NOT NULL").select(*_keys(), F.posexplode(F.filter(numbered, lambda s: F.trim(s["x"]) != "")).alias("j", "s"))
    x = F.col("s.x")
    return solid.select(
        "d", "t", F.col("s.i").alias("i"), "j", F.xxhash64(x).alias("h"), F.hash(x).alias("g"),
        (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w"),
    )


def _rank(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``r``, which orders them by ``by``; rows whose values occur once are dropped."""
    pairs = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ranks = materialize(pairs.orderBy(*by).withColumn("r", F.monotonically_increasing_id()), "ranks")
    return rows.join(ranks, by).drop(*by)


def _ahead(offset: int, column: str = "r") -> Column:
    """``column`` of the suffix ``offset`` lines further on, null where the run breaks before."""
    order = Window.partitionBy("d", "t").orderBy("j")
    if not offset:
        return F.col(column)
    return F.when(F.lead("j", offset).over(order) == F.col("j") + offset, F.lead(column, offset).over(order))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """All lines of ``docs`` and, as ``d, t, j``, those that lie in a later copy of a repeated run."""
    lines = materialize(_lines(docs).dropDuplicates(["d", "t", "i"]), "lines")
    suffixes = materialize(_rank(lines.select("d", "t", "j", "w", "h", "g"), ["h", "g"]), "suffixes")

    order = Window.partitionBy("d", "t").orderBy("j")
    total, size = F.col("w"), F.when(F.col("w") >= min_words, 1)
    for m in range(2, min_words + 1):
        total = total + F.when(F.lead("j", m - 1).over(order) == F.col("j") + (m - 1), F.lead("w", m - 1).over(order))
        size = size.when(total >= min_words, m)
    suffixes = materialize(suffixes.select("d", "t", "j", size.alias("m"), "r"), "suffixes")

    copies = None
    k = 0
    while True:
        span = 1 << k
        ends = F.lit(None).cast("long")
        for m in range(span, min(2 * span, min_words + 1)):
            ends = F.when(F.col("m") == m, _ahead(m - span)).otherwise(ends)
        runs = suffixes.withColumn("e", ends).where((F.col("m") >= span) & (F.col("m") < 2 * span) & F.col("e").isNotNull()).select("m", "r", "e", "d", "t", "j")
        intervals = runs.groupBy("m", "r", "e").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "j")).alias("first")).where("n > 1")
        later = runs.join(intervals, ["m", "r", "e"]).where(F.struct("d", "t", "j") > F.col("first"))
        found = materialize(later.select("d", "t", F.explode(F.sequence(F.col("j"), F.col("j") + F.col("m") - 1)).alias("j")).distinct(), "copies")
        copies = found if copies is None else copies.unionByName(found)
        k += 1
        if 1 << k > min_words:
            break
        doubled = suffixes.select("d", "t", "j", "m", F.col("r").alias("a"), _ahead(span).alias("b")).where("b IS NOT NULL")
        suffixes = materialize(_rank(doubled, ["a", "b"]), "suffixes")
    return lines, copies.distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs taken out of ``text``; plus ``n_lines, n_removed``, which replace columns of these names.

    Order is by id, then by a hash of the text, then by line; the first occurrence stays. Blank lines are never
    removed and don't break a run; rows with equal id and text are one document and are changed alike, and rows without
    id come before all others; null and empty texts stay as they are. A document shorter than ``min_words`` words is
    left alone.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _without_copies(docs.select(*own), min_words, "n_lines", "n_removed")


def _without_copies(docs: DataFrame, min_words: int, n_lines: str, n_removed: str) -> DataFrame:
    """``docs``, all columns, changed as above; plus counts of lines and of those removed under these names."""
    lines, copies = repeated_lines(docs, min_words)
    flagged = lines.join(copies.withColumn("gone", F.lit(True)), ["d", "t", "j"], "left")
    masks = (
        flagged.groupBy("d", "t")
        .agg(F.sum(F.when(F.col("gone"), 1).otherwise(0)).cast("long").alias("removed"), F.sort_array(F.collect_list(F.struct("i", F.coalesce("gone", F.lit(False)).alias("gone")))).alias("mask"))
        .where("removed > 0")
        .select("d", "t", "removed", F.col("mask.i").alias("at"), F.col("mask.gone").alias("gone"))
    )
    d, t = _keys()
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*[F.struct(*others).alias("row")] * bool(others), "text", d.alias("d"), t.alias("t"))
    joined = rows.join(masks, ["d", "t"], "left")
    # the mask lists the lines that are not blank; blank ones in between shift the index, so it is laid out over all lines
    dense = F.flatten(
        F.transform(
            F.col("at"),
            lambda i, k: F.concat(
                F.array_repeat(F.lit(False), i - F.when(k == 0, -1).otherwise(F.get(F.col("at"), k - 1)) - 1),
                F.array(F.get(F.col("gone"), k)),
            ),
        )
    )
    joined = joined.withColumn("dense", dense)
    split = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.coalesce(F.get(F.col("dense"), i), F.lit(False))), "\n")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text")
    return joined.select(
        *[text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias(n_lines), F.coalesce("removed", F.lit(0)).cast("long").alias(n_removed),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every document (null texts count as empty)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated runs go; a document goes if all that it holds are such copies."""
    removed = "removed"
    while any(c.lower().startswith(removed) for c in docs.columns):
        removed += "_"
    out = _without_copies(docs, MIN_WORDS, f"{removed}_lines", removed).where((F.col(removed) == 0) | (F.trim(F.translate("text", "\n", "")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


ORACLE_SQL = f"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM s),
n AS (SELECT doc_id, i, ls[i + 1] AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j,
             length(ls[i + 1]) - length(replace(ls[i + 1], ' ', '')) + 1 AS w
      FROM l WHERE trim(ls[i + 1], ' ') <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY j) AS c FROM n),
e AS (SELECT a.doc_id, a.j, min(b.j) AS e FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.j BETWEEN a.j AND a.j + {MIN_WORDS - 1}
      AND b.c - a.c + a.w >= {MIN_WORDS} GROUP BY ALL),
r AS (SELECT e.doc_id, e.j, e.e, string_agg(n.line, chr(10) ORDER BY n.j) AS run FROM e JOIN n
      ON n.doc_id = e.doc_id AND n.j BETWEEN e.j AND e.e GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, j) AS k FROM r),
g AS (SELECT DISTINCT n.doc_id, n.i FROM f JOIN n ON f.k > 1 AND n.doc_id = f.doc_id AND n.j BETWEEN f.j AND f.e),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
             coalesce(string_agg(l.ls[l.i + 1], chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
