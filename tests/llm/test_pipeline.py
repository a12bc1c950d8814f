"""The pipeline over a small corpus against its stages by brute force."""

import hashlib
import random

import public_tokenizers
from test_corpus_operators import SCHEMA, brute_lines, near_components
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodeweave.llm import line_dedup

RNG = random.Random(5)


def test_pipeline_keeps_what_the_stages_keep(spark, tmp_path):
    kinds = {"aa": "bcdfaeiou", "bb": "ghjkaeo"}

    def text(lang, n):
        return " ".join("".join(RNG.choice(kinds[lang]) for _ in range(5)) for _ in range(n))

    rows = [(i, "\n".join(text(lang, RNG.randint(3, 30)) for _ in range(RNG.randint(1, 4))), lang) for i in range(60) for lang in [RNG.choice(list(kinds))]]
    item = text("aa", 30)
    shared = text("bb", 25)
    rows += [(100, rows[5][1], "aa"), (101, text("aa", 12) + "\n" + shared, "aa"), (102, text("aa", 14) + "\n" + shared, "bb"), (103, f"{text('aa', 20)} {item} {text('aa', 9)}", None), (104, "12 34 ---", None), (105, None, "aa")]
    near = rows[7][1].replace("\n", " ") + " " + text("aa", 60)
    rows += [(106, near, "aa"), (107, near + " again", "aa")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)
    docs = docs.withColumns({"h": F.lit(1), "d": F.lit("x"), "gone": F.lit(2), "removed": F.lit(3), "ids": F.lit(4), "sid": F.lit(5)})  # names that the stages use
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t) for i, t, _ in rows if i not in (104, 105)]
    lines = brute_lines(kept, line_dedup.MIN_WORDS)
    before = dict(kept)
    kept = [(i, t) for i, t in lines.items() if t == before[i] or t.strip()]
    assert 100 not in dict(kept) and shared not in dict(kept)[102]
    component = near_components(kept)
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    assert 107 not in dict(kept)
    kept = [(i, t) for i, t in kept if item not in t]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in kept:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_pipeline_of_an_empty_table_and_of_repeated_rows(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    other = tmp_path / "other"
    spark.createDataFrame([(1, "a b c d e f", "aa", "s", 11)] * 2 + [(None, "a b c d e f", "aa", "s", 11), (None, None, None, None, None)], SCHEMA).write.parquet(f"{other}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{other}/benchmark.parquet")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.run(spark, str(other)).collect()) == [(False, 1, 6), (False, 1, 6), (True, 0, 6)]
