"""The persisted graph index: recall against all rows, what a search reads, reuse, appends and odd vectors."""

import numpy as np
import pytest

from ragweave.operators import search, vector_index
from ragweave.storage import fresh_path


def clustered(spark, n, groups, dims=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = (centres[rng.integers(0, groups, n)] + rng.normal(0, 0.35, (n, dims))).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def ask(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in v]) for i, v in enumerate(vectors)], "query_id long, query_vec array<float>")


def recall(found, exact, k):
    want, got = {}, {}
    for r in exact.collect():
        want.setdefault(r.query_id, set()).add(r.vec_id)
    for r in found:
        got.setdefault(r.query_id, set()).add(r.id)
    return np.mean([len(want[q] & got.get(q, set())) / k for q in want])


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_reuse_and_share_read(spark, metric):
    x, df = clustered(spark, 12_000, 40)
    df = df.persist()
    path = fresh_path(spark, "index")
    vector_index.build(df, path, m=12, ef_construction=48, cells=24, shard_rows=1000, metric=metric)
    files = sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/shards").select("path", "modificationTime").collect())
    rng = np.random.default_rng(3)
    for seed in (0, 1):  # the second search uses what the first one did
        asked = ask(spark, x[rng.integers(0, len(x), 60)] + rng.normal(0, 0.1, (60, 32)), 100 * seed)
        found = vector_index.search(spark, path, asked, 10, ef_runtime=48, probes=4).collect()
        exact = search.knn_each(df, asked, 10, metric)
        assert recall(found, exact, 10) >= 0.9
        assert np.mean([r.n_compared for r in found]) < len(x) / 5
    again = sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/shards").select("path", "modificationTime").collect())
    assert again == files
    exact = {(r.query_id, r.vec_id): r.distance for r in search.knn_each(df, asked, 20, metric).collect()}
    assert all(abs(r.distance - exact[r.query_id, r.id]) < 1e-4 for r in found if (r.query_id, r.id) in exact)
    df.unpersist()


def test_only_the_cells_that_are_looked_into_are_read(spark):
    x, df = clustered(spark, 2000, 8)
    path = fresh_path(spark, "index")
    vector_index.build(df, path, cells=8, shard_rows=500)
    plan = vector_index.search(spark, path, ask(spark, x[:1]), 5, probes=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" in plan and "IN (" in plan or "In(" in plan or "(cell" in plan
    read = vector_index.search(spark, path, ask(spark, x[:1]), 5, probes=2).collect()
    assert len(read) == 5 and read[0].n_compared < 2000


def test_odd_vectors_appends_and_errors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [nan, 1.0]), (6, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (8, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    path = fresh_path(spark, "index")
    vector_index.build(df, path)
    asked = ask(spark, [[1.0, 0.1]])
    assert [(r.id, r["rank"]) for r in vector_index.search(spark, path, asked, 5).orderBy("rank").collect()] == [(1, 1), (7, 2), (2, 3)]
    vector_index.append(spark.createDataFrame([(9, [1.0, 0.1])], "vec_id long, embedding array<float>"), path)
    assert vector_index.search(spark, path, asked, 1).first().id == 9
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0])], "query_id long, query_vec array<float>")
    assert {r.query_id for r in vector_index.search(spark, path, odd, 1).collect()} == {3}
    with pytest.raises(ValueError):
        vector_index.build(df, path)
    with pytest.raises(ValueError):
        vector_index.build(df, path + "-x", metric="ip")
    empty = fresh_path(spark, "index")
    vector_index.build(df.limit(0), empty)
    assert vector_index.search(spark, empty, asked, 3).count() == 0


def test_query_of_all_embeddings(spark):
    from ragweave import plans

    registry = plans.load()
    sf = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.vec_id) for r in registry.QUERIES["knn_batch_topk_per_query"](spark, sf).collect()}
    found = registry.QUERIES["vector_index_topk"](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert len(exact & {(r.query_id, r.vec_id) for r in found}) / len(exact) >= 0.9
    assert np.mean([r.n_compared for r in found]) <= n / 5
