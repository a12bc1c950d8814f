"""The inverted-file index against brute force."""

import numpy as np
import pytest

from lodeweave.operators import vector_index
from lodeweave.plans import graph
from lodeweave.sources import fixtures as X

SF = "/root/testdata/sf0.01"


def brute(queries, rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q, v in queries:
        apart = ((x - np.array(v)) ** 2).sum(1)
        out[q] = [int(ids[i]) for i in np.lexsort((ids, apart))[:k]]
    return out


def shown(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 8)) * 3
    rows = [(i, (centres[i % 20] + rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a third of the vectors are one
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)


def test_index_is_written_and_searched(spark, table, tmp_path):
    rows, df = table
    odd = spark.createDataFrame([(None, rows[0][1]), (5000, None)], df.schema)
    path = str(tmp_path / "index")
    vector_index.build_index(df.unionByName(odd), path, cells=24, list_rows=100)
    index = vector_index.load_index(spark, path)
    assert index.lists.count() == 900 and index.cells.agg({"parts": "max"}).first()[0] >= 3
    queries = df.where("vec_id % 20 = 0 OR vec_id = 1001")
    want = brute([r for r in rows if r[0] % 20 == 0 or r[0] == 1001], rows, 10)
    assert shown(vector_index.search_exactly(index, queries.unionByName(odd), 10, nprobe=2, list_queries=7)) == want
    every = vector_index.search(index, queries, 10, nprobe=100, list_queries=7)
    assert shown(every) == want == shown(vector_index.nearest(queries, df, 10, block_rows=64))
    assert [tuple(r) for r in every.sort("query_id", "rank").collect()] == [tuple(r) for r in vector_index.nearest(queries, df, 10).sort("query_id", "rank").collect()]
    found = shown(vector_index.search(index, queries, 10, nprobe=3))
    assert np.mean([len(set(found[q]) & set(w)) / 10 for q, w in want.items()]) >= 0.9
    assert vector_index.search(index, queries.limit(0), 10).count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.build_index(df.limit(0), str(tmp_path / "none"))


def test_search_reads_only_folders_of_probed_cells(spark, table, tmp_path):
    rows, df = table
    index = vector_index.build_index(df, str(tmp_path / "index"), cells=24)
    near = vector_index.search(index, df.where("vec_id = 40"), 5, nprobe=2)
    folders = [line for line in near._jdf.queryExecution().toString().splitlines() if "FileScan" in line and "part#" in line]
    assert folders and all("cell" in line.split("artitionFilters")[1] and " IN (" in line.split("artitionFilters")[1] for line in folders), folders
    assert [r.vec_id for r in near.orderBy("rank").collect()][0] == 40


def test_recall_of_the_query(spark):
    vectors = X.vectors(spark, SF)
    rows = [(r.vec_id, np.asarray(r.embedding, np.float64)) for r in vectors.select("vec_id", "embedding").collect()]
    want = brute([r for r in rows if r[0] % 100 == 0], rows, 10)
    found = {}
    for r in graph.knn_index(spark, SF).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & set(w)) / 10 for q, w in want.items()]) >= 0.9
