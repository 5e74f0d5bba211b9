"""Nearest-neighbour retrieval over a table of vectors, with filters, neighbours and levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.functions import vectors as V
from ragweave.operators import ranges
from ragweave.storage import fresh_path

#: Query vectors that are broadcast at once; more are taken in blocks of this many.
QUERY_BLOCK = 4096
TYPES = ("similarity", "similarity_distance_threshold", "similarity_search_with_siblings", "mmr", "similarity_score_threshold")


def knn(corpus: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows to one vector; ties go to the smaller id. Filters act before ranking."""
    if k < 1:
        raise ValueError("k must be positive")
    rows = corpus if where is None else corpus.filter(where)
    target = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", V.distance(vec_col, target, metric)).filter("distance is not null").orderBy("distance", id_col).limit(k)


def nearest_within(corpus: DataFrame, query: list[float], k: int, threshold: float | None, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """As ``knn``, but only rows within ``threshold``."""
    if threshold is None:
        raise ValueError("a distance threshold is needed")
    target = F.array(*[F.lit(float(x)) for x in query])
    return knn(corpus, query, k, metric, V.distance(vec_col, target, metric) <= threshold, id_col, vec_col)


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(rows, queries) distances of doubles; not a number where cosine has a zero vector."""
    if metric == "l2":
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (x @ q.T), 0))
    dots = x @ q.T
    if metric == "ip":
        return 1 - dots
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dots / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :])


def _nearest_of_batches(corpus: DataFrame, ids: list, q: np.ndarray, k: int, metric: str, id_col: str, vec_col: str, cells: tuple[list[list[float]], int] | None = None) -> DataFrame:
    """(query_id, id, distance): each query's ``k`` nearest rows of every batch, ties by id.

    With ``cells`` (centres, probes) a query meets only rows whose nearest centre is among its ``probes`` nearest.
    """
    centres = np.array(cells[0], float) if cells else None
    near = np.argsort(_distances(q, centres, metric), axis=1, kind="stable")[:, : cells[1]] if cells else None
    step = max(1, (1 << 22) // len(ids))  # distances held at once
    schema = T.StructType([T.StructField("query_id", T.LongType()), corpus.schema[id_col], T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            batch = batch.filter(pc.and_kleene(pc.is_valid(batch.column(0)), pc.equal(pc.list_value_length(batch.column(1)), q.shape[1])))
            if not batch.num_rows:
                continue
            names = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(names, kind="stable")
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)[order]
            d = _distances(x, q, metric) if cells is None else _within_cells(x, q, metric, centres, near)
            best = np.argsort(np.nan_to_num(d, nan=np.inf), axis=0, kind="stable")[:k] if len(d) <= 4 * k else _least(d, k)
            found = np.take_along_axis(d, best, 0)
            asked = np.repeat(np.asarray(ids, np.int64)[None, :], len(best), 0)
            good = ~np.isnan(found)
            yield pa.RecordBatch.from_arrays([pa.array(asked[good]), batch.column(0).take(pa.array(order[best[good]])), pa.array(found[good])], schema.names)

    return corpus.select(id_col, vec_col).mapInArrow(run, schema)


def _within_cells(x: np.ndarray, q: np.ndarray, metric: str, centres: np.ndarray, near: np.ndarray) -> np.ndarray:
    """(rows, queries) distances, not a number where a row's cell isn't among the query's; ``near``: each query's cells."""
    out, own = np.full((len(x), len(q)), np.nan), _distances(x, centres, metric).argmin(1)
    for c in np.unique(own):
        rows, asked = np.flatnonzero(own == c), np.flatnonzero((near == c).any(1))
        out[np.ix_(rows, asked)] = _distances(x[rows], q[asked], metric)
    return out


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Rows of each column's ``k`` least values, ties by row."""
    d = np.nan_to_num(d, nan=np.inf)
    out = np.empty((k, d.shape[1]), np.int64)
    limit = np.partition(d, k - 1, axis=0)[k - 1]
    for c in range(d.shape[1]):
        near = np.flatnonzero(d[:, c] <= limit[c])
        out[:, c] = near[np.argsort(d[near, c], kind="stable")[:k]]
    return out


def knn_each(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERY_BLOCK, cells: tuple[list[list[float]], int] | None = None) -> DataFrame:
    """The ``k`` nearest corpus rows of every query (query_id long, query_vec): query_id, id, distance, rank.

    A batch of rows is one matrix product against a block of about ``block`` query vectors and gives each
    query's ``k`` best of the batch, so pairs are neither sorted nor shuffled. More queries are taken block
    by block: the driver holds one block, and what a block finds is added to a table in the shared folder,
    so neither its memory nor the plan grows with them. ``cells``: as in ``knn_cells``.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    schema = T.StructType([T.StructField("query_id", T.LongType()), corpus.schema[id_col], T.StructField("distance", T.DoubleType())])
    spark, path, found = corpus.sparkSession, None, None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.select("query_id", "query_vec").collect()
        if not rows:
            continue
        near = _nearest_of_batches(corpus, [r[0] for r in rows], np.array([r[1] for r in rows], float), k, metric, id_col, vec_col, cells)
        if blocks == 1:
            found = near
        else:
            path = path or fresh_path(spark, "nearest")
            near.write.mode("append").parquet(path)
    if path:
        found = spark.read.schema(schema).parquet(path)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def with_siblings(chunks: DataFrame, file_cols: list[str], order_col: str, id_col: str) -> DataFrame:
    """``chunks`` with previous_id and next_id: the neighbours in the same file (and under the same headers)."""
    return ranges.with_neighbours(chunks, file_cols, order_col, id_col)


def hits_with_siblings(hits: DataFrame, chunks: DataFrame, file_cols: list[str], order_col: str, id_col: str) -> DataFrame:
    """Hits with the ids of their neighbours; no file is sorted as a whole, and only around hits."""
    return ranges.nearest_around(hits, chunks, file_cols, order_col, id_col)


def hierarchical(summaries: DataFrame, chunks: DataFrame, query: list[float], k_summaries: int, k_chunks: int, keys: list[str], metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k_chunks`` nearest chunks under each of the ``k_summaries`` nearest summaries."""
    target = F.array(*[F.lit(float(x)) for x in query])
    top = summaries.withColumn("summary_distance", V.distance(vec_col, target, metric)).orderBy("summary_distance", *keys).limit(k_summaries)
    under = chunks.join(F.broadcast(top.select(*keys, "summary_distance")), keys)
    best = Window.partitionBy(*keys).orderBy("distance", id_col)
    scored = under.withColumn("distance", V.distance(vec_col, target, metric)).filter("distance is not null").withColumn("rank", F.row_number().over(best))
    return scored.filter(F.col("rank") <= k_chunks)


def mmr(candidates: DataFrame, query: list[float], k: int, weight: float = 0.5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Maximal marginal relevance over a bounded candidate set (fetch_k rows of ``knn``): id, rank, score.

    Greedy by nature; the candidates are one query's top rows, so one task holds ``fetch_k`` vectors.
    """
    import pandas as pd

    target = np.asarray(query, float)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        m = np.stack([np.asarray(v, float) for v in pdf["vec"]])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near = m @ (target / np.linalg.norm(target))
        twin = np.full(len(m), -np.inf)
        left, out = np.ones(len(m), bool), []
        for rank in range(1, min(k, len(m)) + 1):
            score = near if rank == 1 else weight * near - (1 - weight) * twin
            best = int(np.argmax(np.where(left, score, -np.inf)))
            out.append((int(pdf["id"][best]), rank, float(score[best])))
            left[best] = False
            twin = np.maximum(twin, m @ m[best])
        return pd.DataFrame(out, columns=["id", "rank", "score"])

    rows = candidates.select(F.lit(0).alias("one"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    return rows.groupBy("one").applyInPandas(pick, "id long, rank int, score double").withColumnRenamed("id", id_col)


def search(corpus: DataFrame, query: list[float], kind: str = "similarity", k: int = 4, **options: object) -> DataFrame:
    """Dispatch on the kind of search; an unknown kind is an error."""
    if kind == "similarity":
        return knn(corpus, query, k, **options)
    if kind == "similarity_distance_threshold":
        return nearest_within(corpus, query, k, **options)
    if kind == "similarity_search_with_siblings":
        files, order = options.pop("file_cols"), options.pop("order_col")
        id_col = options.get("id_col", "vec_id")
        return hits_with_siblings(knn(corpus, query, k, **options), corpus, files, order, id_col)
    if kind == "mmr":
        weight, fetch = options.pop("lambda_mult", 0.5), options.pop("fetch_k", 20)
        return mmr(knn(corpus, query, fetch, **options), query, k, weight)
    if kind == "similarity_score_threshold":
        least = options.pop("score_threshold")
        return nearest_within(corpus, query, k, 1 - least, **options)
    raise ValueError(f"unknown search {kind}")


def fit_cells(sample: DataFrame, cells: int, rounds: int = 8, most: int = 20_000, seed: int = 3, vec_col: str = "embedding") -> list[list[float]]:
    """Centres of an inverted-file index, by k-means on about ``most`` distinct vectors taken by a hash."""
    sample = sample.select(vec_col).distinct()
    share = min(1.0, most / max(1, sample.count()))
    rows = sample.filter(F.pmod(F.xxhash64(vec_col), F.lit(1 << 20)) < share * (1 << 20)).collect()
    x = np.array(sorted(list(r[0]) for r in rows), float)
    if not len(x):
        return []
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.tolist()


def assign_cells(rows: DataFrame, centres: list[list[float]], probes: int = 1, vec_col: str = "embedding") -> DataFrame:
    """``rows`` with array ``cells``: the ``probes`` nearest centres."""
    scored = [F.struct(V.distance(vec_col, F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return rows.withColumn("cells", F.transform(F.slice(F.array_sort(F.array(*scored)), 1, probes), lambda s: s["i"]))


def knn_cells(corpus: DataFrame, queries: DataFrame, centres: list[list[float]], k: int, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Approximate ``knn_each``: every row is indexed in its cell, a query looks into ``probes`` cells.

    The rows of a batch that share a cell are one matrix product against the queries that look into it.
    """
    return knn_each(corpus, queries, k, id_col=id_col, vec_col=vec_col, cells=(centres, probes) if centres else None)
