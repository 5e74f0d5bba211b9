"""Centroid clustering of integer vectors, exact, with block-norm screening.

A vector is 64 integers, ``floor(64 * x)``. Beside them it keeps a compressed form: for each of its
``SEGMENTS`` segments the sum, and the norm of what remains when the segment's mean is taken out. By the
inequality of Cauchy and Schwarz a segment's part of a squared distance is at least the part of the means
plus the squared difference of the remaining norms, so the compressed forms of a vector and a centroid
give a lower bound. The centroid with the smallest bound gets an exact integer distance; so do the others
whose bound, less the rounding that floating point may have added, isn't above it. A pruned centroid is
strictly farther, so ties are settled among exact distances: the smaller number wins.

A round reads the vectors once and gives one row of sums a task and cluster, which are summed exactly; the
driver holds the centroids alone. Vectors aren't shuffled, so copies of one may hold any share of the rows.

Results in special cases: a vector that is null, has another length or a component that is null or not
finite is left out; rows that repeat are clustered each; first centroids with equal hashes (ids that
repeat) go by their components, null ids come last; with fewer vectors than clusters each vector is a
first centroid; an empty table gives an empty result; other columns are ignored. A component whose
integer doesn't lie within ``LARGEST`` raises an error, since a distance could pass a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import materialize

SIZE, SEGMENTS, SCALE = 64, 8, 64
#: 64 squared differences of such components are below 2 ** 63.
LARGEST = 1 << 27
#: Rounding of a bound, as a share of both squared norms; it stays far below this.
SLACK = 1e-11
#: Vectors that are screened at once.
BLOCK = 4096

VECTORS = "vec_id long, parts binary, sums binary, rests binary"


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``column`` that are whole vectors, and their integer components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), SIZE), False).to_numpy(zero_copy_only=False))
    values = pc.list_flatten(column.take(pa.array(fit))).cast(pa.float64())
    values = values.to_numpy(zero_copy_only=False).reshape(-1, SIZE)  # null becomes NaN
    whole = np.isfinite(values).all(1)
    scaled = np.floor(values[whole] * SCALE)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component is {np.abs(scaled).max() / SCALE}: distances are exact below {LARGEST // SCALE} only")
    return fit[whole], scaled.astype(np.int64)


def compressed(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment sums, and norms of what the segment means leave, of rows of integers."""
    cut = parts.reshape(len(parts), SEGMENTS, SIZE // SEGMENTS)
    sums = cut.sum(2)
    n = SIZE // SEGMENTS
    return sums, np.sqrt((n * (cut * cut).sum(2) - sums * sums) / n)


def prepare(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, parts, sums, rests) of the whole vectors: packed integers and their compressed form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                fit, parts = integers(block.column(1))
                sums, rests = compressed(parts)
                packed = [pa.array([x.tobytes() for x in a], pa.binary()) for a in (parts.astype("<i4"), sums.astype("<i4"), rests.astype("<f8"))]
                yield pa.RecordBatch.from_arrays([block.column(0).cast(pa.int64()).take(pa.array(fit)), *packed], ["vec_id", "parts", "sums", "rests"])

    return rows.select(id_col, vec_col).mapInArrow(run, VECTORS)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    kinds = (("parts", "<i4", SIZE), ("sums", "<i4", SEGMENTS), ("rests", "<f8", SEGMENTS))
    out = [np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(-1, n) for c, kind, n in kinds]
    return out[0].astype(np.int64), out[1].astype(np.float64), out[2]


def exact(parts: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, row by row."""
    gap = parts - centres
    return np.einsum("ij,ij->i", gap, gap)


def nearest(parts: np.ndarray, sums: np.ndarray, rests: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, its exact squared distance, and the number of exact distances taken."""
    own_sums, own_rests = compressed(centres)
    n = SIZE // SEGMENTS
    bound = ((sums[:, None, :] - own_sums[None]) ** 2).sum(2) / n + ((rests[:, None, :] - own_rests[None]) ** 2).sum(2)
    squares = (sums * sums).sum(1) / n + (rests * rests).sum(1)
    own_squares = (own_sums * own_sums).sum(1) / n + (own_rests * own_rests).sum(1)
    bound -= SLACK * (squares[:, None] + own_squares[None])
    rows, first = np.arange(len(parts)), bound.argmin(1)
    best = exact(parts, centres[first])
    left = bound <= best[:, None]
    left[rows, first] = False
    found = np.full(bound.shape, np.iinfo(np.int64).max)
    found[rows, first] = best
    row, centre = np.nonzero(left)
    found[row, centre] = exact(parts[row], centres[centre])
    cluster = found.argmin(1)
    return cluster, found[rows, cluster], left.sum(1) + 1


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "parts").orderBy(F.asc_nulls_last("key"), "parts").limit(k).collect()
    return np.array([np.frombuffer(r.parts, "<i4") for r in rows], np.int64).reshape(-1, SIZE)


def moved(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round; a cluster without vectors keeps its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), SIZE), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                parts, sums, rests = _unpacked(batch.slice(at, BLOCK))
                cluster, _, _ = nearest(parts, sums, rests, centres)
                count += np.bincount(cluster, minlength=len(centres))
                np.add.at(total, cluster, parts)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = vectors.mapInArrow(run, "cluster int, n long, total array<long>")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[wide(F.col("total")[j]) for j in range(SIZE)]).alias("total")).collect()
    out = centres.copy()
    for r in rows:
        out[r.cluster] = [int(x) // r.n for x in r.total]
    return out


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, n_exact) of each vector, with the number of distances that screening left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                cluster, distance, n = nearest(*_unpacked(block), centres)
                yield pa.RecordBatch.from_arrays([block.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(n)], ["vec_id", "cluster", "distance", "n_exact"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long, n_exact long")


def train(vectors: DataFrame, k: int = 16, rounds: int = 3) -> np.ndarray:
    """Centroids of ``rounds`` rounds from the first ones; ``vectors`` is a written table of ``prepare``."""
    centres = first_centroids(vectors, k)
    for _ in range(rounds if len(centres) else 0):
        centres = moved(vectors, centres)
    return centres


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, sums of distances of its cluster and of all, and the digest of its centroid."""
    if k < 1:
        raise ValueError("k must be positive")
    vectors = materialize(prepare(rows, id_col, vec_col), "vectors")
    centres = train(vectors, k, rounds)
    found = materialize(assigned(vectors, centres), "assigned")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres.tolist())]
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(i, sums.get(i, 0), sum(sums.values()), d) for i, d in digests]
    own = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row for each of k clusters
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """DuckDB SQL for ``cluster`` over ``embeddings``."""
    ctes = [
        f"v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS p FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, p) - 1 AS c, p FROM v QUALIFY c < {k})",
    ]
    far = "list_sum(list_transform(list_zip(v.p, c.p), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT"
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS (SELECT v.id, any_value(v.vec_id) AS vec_id, any_value(v.p) AS p, min(({{'d': {far}, 'c': c.c}})) AS b FROM v, c{r} c GROUP BY v.id)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT b.c AS c, j, count(*) AS n, sum(p[j]) AS s FROM a{r}, range(1, {SIZE + 1}) t(j) GROUP BY ALL)")
            ctes.append(f"m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS p FROM s{r} GROUP BY c)")
            ctes.append(f"c{r + 1} AS (SELECT c.c, coalesce(m.p, c.p) AS p FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    return f"""
        WITH {", ".join(ctes)}
        SELECT vec_id, b.c::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.p, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.c = a.b.c"""
