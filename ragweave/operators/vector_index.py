"""A persisted approximate vector index: cells by nearest centre, in each a hierarchical graph of neighbours.

``build`` fits centres on a bounded sample, puts every vector in the cell of its nearest centre, deals a
cell into shards of about ``shard_rows`` vectors and links each shard's vectors in its own task. A shard is
one row of packed arrays (ids, vectors, links of each level) in a folder of its cell, so a search reads the
shards of the cells that its queries look into and nothing else, and a second search builds nothing.

A shard's graph has levels: each vector is on the lowest, a sixteenth of a level's vectors on the next.
On a level a vector is linked to up to ``m`` (lowest: 2 * ``m``) of its ``ef_construction`` nearest ones,
leaving out those that are nearer to a chosen neighbour than to itself, and links run both ways. A search
starts on the top, walks greedily down and keeps the ``ef_runtime`` best on the lowest level; all queries of a
shard walk together, a step of each at once. ``n_compared`` counts the vectors whose distance a query took.

Distances are of cosine or l2 in single precision; ties go to the smaller id. Null vectors, vectors of another length and,
for cosine, zero vectors are not indexed. Vectors can be appended: they form further shards of the cells.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragweave.storage import file_system, materialize

METRICS = ("cosine", "l2")
#: Vectors that centres are fitted on at most, cells at most (their centres go to every task), rounds of fitting.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 8
#: Queries that walk a shard together.
BLOCK = 128
SHARD = "cell int, n int, ids binary, vectors binary, levels array<struct<members: binary, links: binary>>"
#: Share of a level's vectors that the next one has, one in so many.
THINNER = 16


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    return np.ascontiguousarray(x, np.float32)


def _rows(column: pa.Array, size: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and matrix of the usable vectors of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    x = pc.list_flatten(column.take(pa.array(fit))).cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, size)
    good = np.isfinite(x).all(1)
    if metric == "cosine":
        good &= (x != 0).any(1)
    return fit[good], _unit(x[good], metric)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def fit_centres(x: np.ndarray, cells: int, metric: str, seed: int = 7) -> np.ndarray:
    """Centres of a sample by k-means; an empty cell keeps its centre."""
    if not len(x):
        return x
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([_squares(x[a : a + 2048], centres).argmin(1) for a in range(0, len(x), 2048)])
        sums = np.zeros((len(centres), x.shape[1]))
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = _unit(np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres), metric)
    return centres


def _diverse(x: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of each row's sorted candidates up to ``most``: a candidate nearer to a chosen one than to the row waits till the end.

    ``near``: (rows, candidates) places, ``far``: their squared distances. Unused places are -1.
    """
    n, width = near.shape
    out = np.full((n, most), -1, np.int32)
    count, chosen = np.zeros(n, np.int64), np.zeros((n, width), bool)
    for j in range(width):
        here = near[:, j]
        gap = x[np.maximum(out, 0)] - x[here][:, None, :]
        close = (np.einsum("ijk,ijk->ij", gap, gap) < far[:, j][:, None]) & (out >= 0)
        take = ~close.any(1) & (count < most) & np.isfinite(far[:, j])
        out[take, count[take]] = here[take]
        count[take] += 1
        chosen[:, j] = take
    for j in range(width):  # places that are left go to the nearest that waited
        take = ~chosen[:, j] & (count < most) & np.isfinite(far[:, j])
        out[take, count[take]] = near[take, j]
        count[take] += 1
    return out


def link(x: np.ndarray, most: int, candidates: int) -> np.ndarray:
    """(rows, 2 * most) links of one level, both ways; -1 where there is none."""
    n = len(x)
    width = min(candidates, n - 1)
    forward = np.full((n, most), -1, np.int32)
    if width < 1:
        return np.full((n, 2 * most), -1, np.int32)
    for a in range(0, n, 512):
        block = x[a : a + 512]
        d = _squares(block, x)
        d[np.arange(len(block)), np.arange(a, a + len(block))] = np.inf
        near = np.argpartition(d, width - 1, axis=1)[:, :width]
        far = np.take_along_axis(d, near, 1)
        order = np.argsort(far, axis=1, kind="stable")
        forward[a : a + len(block)] = _diverse(x, np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1), most)
    out = np.full((n, 2 * most), -1, np.int32)
    out[:, :most] = forward
    u, slot = np.nonzero(forward >= 0)
    v = forward[u, slot]
    back = (forward[v] == u[:, None]).any(1)  # the other end has the link already
    u, v = u[~back], v[~back]
    order = np.lexsort((np.einsum("ij,ij->i", x[u] - x[v], x[u] - x[v]), v))
    u, v = u[order], v[order]
    first = np.searchsorted(v, np.arange(n))
    nth = np.arange(len(v)) - first[v]
    keep = nth < most
    out[v[keep], most + nth[keep]] = u[keep]
    return out


def shard_levels(x: np.ndarray, m: int, ef_construction: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, links between places among them) of each level, the lowest first."""
    order = np.random.default_rng(seed).permutation(len(x)).astype(np.int32)
    levels, n = [], len(x)
    while True:
        members = np.arange(n, dtype=np.int32) if not levels else np.sort(order[:n])
        levels.append((members, link(x[members], m, ef_construction)))
        n //= THINNER
        if n < 2:
            return levels


def walk(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, squared distances) of the ``k`` best found for each query, and how many distances each took."""
    members, _ = levels[-1]
    start = np.zeros(len(q), np.int64)
    taken = np.zeros(len(q), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        members, links = levels[depth]
        own = x[members] if depth else x
        at, far, n = _beam(own, links, q, start, 1 if depth else max(ef, k))
        taken += n
        if depth:
            start = members[at[:, 0]].astype(np.int64) if depth == 1 else np.searchsorted(levels[depth - 1][0], members[at[:, 0]])
    return at[:, :k], far[:, :k], taken


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: in a step each expands its nearest place that it hasn't."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(x) + 1), bool)  # the last column stands for no link
    seen[:, -1] = True
    gap = q - x[start]
    at = np.full((len(q), ef), -1, np.int64)
    far = np.full((len(q), ef), np.inf, np.float32)
    open_ = np.zeros((len(q), ef), bool)
    at[:, 0], far[:, 0], open_[:, 0] = start, np.einsum("ij,ij->i", gap, gap), True
    seen[rows, start] = True
    taken = np.ones(len(q), np.int64)
    live = rows
    while len(live):
        best = np.where(open_[live], far[live], np.inf).argmin(1)
        go = open_[live, best]
        live, best = live[go], best[go]
        if not len(live):
            break
        open_[live, best] = False
        near = links[at[live, best]].astype(np.int64)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        i, j = np.nonzero(fresh)
        gap = q[live[i]] - x[near[i, j]]
        d = np.full(near.shape, np.inf, np.float32)
        d[i, j] = np.einsum("ij,ij->i", gap, gap)
        taken[live] += fresh.sum(1)
        both, places = np.concatenate([far[live], d], 1), np.concatenate([at[live], near], 1)
        opens = np.concatenate([open_[live], fresh], 1)
        order = np.argsort(both, axis=1, kind="stable")[:, :ef]
        far[live], at[live], open_[live] = (np.take_along_axis(a, order, 1) for a in (both, places, opens))
        open_[live] &= np.isfinite(far[live])
    return at, far, taken


def _meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])


def _dealt(vectors: DataFrame, meta: dict, id_col: str, vec_col: str) -> DataFrame:
    """(id, cell, vector) of the usable vectors."""
    centres, metric = np.array(meta["centres"], np.float32), meta["metric"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 4096) for b in batches for a in range(0, b.num_rows, 4096)):
            fit, x = _rows(batch.column(1), centres.shape[1], metric)
            cell = _squares(x, centres).argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(fit)), pa.array(cell), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "cell", "vector"])

    return vectors.filter(F.col(id_col).isNotNull()).select(id_col, vec_col).mapInArrow(run, "id long, cell int, vector binary")


def append(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Index further vectors: they form new shards of the cells that ``build`` has fitted."""
    spark = vectors.sparkSession
    meta = _meta(spark, path)
    dealt = materialize(_dealt(vectors, meta, id_col, vec_col), "index-rows")
    sizes = materialize(dealt.groupBy("cell").agg(F.count("*").alias("n")), "cell-sizes")
    shards = F.greatest(F.lit(1), F.ceil(F.col("n") / meta["shard_rows"]).cast("int"))
    size, m, ef = len(meta["centres"][0]), meta["m"], meta["ef_construction"]

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids = table.column("id").to_numpy()[order].astype("<i8")
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<f4").reshape(-1, size)[order]
        levels = [{"members": a.astype("<i4").tobytes(), "links": b.astype("<i4").tobytes()} for a, b in shard_levels(x, m, ef)]
        kinds = pa.list_(pa.struct([("members", pa.binary()), ("links", pa.binary())]))
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()], pa.int32()), "n": pa.array([len(x)], pa.int32()), "ids": [ids.tobytes()], "vectors": [np.ascontiguousarray(x, "<f4").tobytes()], "levels": pa.array([levels], kinds)})

    sized = dealt.join(F.broadcast(sizes), "cell")  # a row for each of at most MOST_CELLS cells
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64("id"), shards).cast("int"))
    built = sharded.select("cell", "shard", "id", "vector").groupBy("cell", "shard").applyInArrow(run, SHARD)
    built.write.mode("append").partitionBy("cell").parquet(f"{path}/shards")


def build(vectors: DataFrame, path: str, m: int = 16, ef_construction: int = 64, cells: int | None = None, shard_rows: int = 8192, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Index ``vectors`` under ``path``, which must not exist. Without ``cells``, one for every shard's worth of rows."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if m < 2 or ef_construction < m:
        raise ValueError("m must be 2 at least, and ef_construction m at least")
    spark = vectors.sparkSession
    fs, make = file_system(spark, path)
    if fs.exists(make(path)):
        raise ValueError(f"there is something at {path}")
    usable = vectors.filter(F.col(id_col).isNotNull() & (F.size(vec_col) > 0))
    total = usable.count()
    first = usable.select(F.size(vec_col)).first()
    share = min(1.0, SAMPLE / max(1, total))
    sample = usable.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(vec_col).limit(2 * SAMPLE).toArrow().column(0)
    size = first[0] if first else 1
    x = _rows(sample, size, metric)[1]
    number = min(MOST_CELLS, cells or max(1, round(total / shard_rows)))
    centres = fit_centres(x[np.lexsort(x.T)] if len(x) else np.zeros((1, size), np.float32), number, metric)
    meta = {"metric": metric, "m": m, "ef_construction": ef_construction, "shard_rows": shard_rows, "centres": centres.tolist()}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")
    append(vectors, path, id_col, vec_col)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, ef_runtime: int = 64, probes: int = 1) -> DataFrame:
    """(query_id, id, distance, rank, n_compared) of about the ``k`` nearest vectors of each query (query_id, query_vec).

    A query looks into the cells of its ``probes`` nearest centres; the shards of other cells aren't read.
    """
    meta = _meta(spark, path)
    metric, centres = meta["metric"], np.array(meta["centres"], np.float32)
    size = centres.shape[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 4096) for b in batches for a in range(0, b.num_rows, 4096)):
            fit, q = _rows(batch.column(1), size, metric)
            d = _squares(q, centres)
            near = np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)
            n = near.shape[1]
            ids = np.repeat(batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)[fit], n)
            yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1)), pa.array(ids), pa.array([r.tobytes() for r in q for _ in range(n)], pa.binary())], ["cell", "query_id", "vector"])

    asked = queries.filter(F.col("query_id").isNotNull()).select("query_id", "query_vec").mapInArrow(deal, "cell int, query_id long, vector binary")
    asked = materialize(asked, "asked")
    cells = [r.cell for r in asked.select("cell").distinct().collect()]
    # blocks of bounded size: a cell that many queries look into is walked by many tasks
    n = asked.groupBy("cell").agg(F.count("*").alias("asks"))
    blocks = asked.join(materialize(n, "asks"), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("asks") / BLOCK)).cast("int"))
    blocks = blocks.groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards").filter(F.col("cell").isin(cells))
    pairs = shards.join(materialize(blocks, "asked-blocks"), "cell").select("n", "ids", "vectors", "levels", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), "<i8")
                x = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<f4").reshape(-1, size)
                levels = []
                for level in batch.column("levels")[i].as_py():
                    members = np.frombuffer(level["members"], "<i4")
                    levels.append((members, np.frombuffer(level["links"], "<i4").reshape(len(members), -1)))
                own = batch.column("asked")[i].values
                q = np.frombuffer(b"".join(own.field("vector").to_pylist()), "<f4").reshape(-1, size)
                at, far, taken = walk(x, levels, q, k, ef_runtime)
                good = np.isfinite(far)
                names = np.repeat(own.field("query_id").to_numpy()[:, None], at.shape[1], 1)
                distance = far / 2 if metric == "cosine" else np.sqrt(far)
                counts = np.zeros(at.shape, np.int64)
                counts[:, 0] = taken
                yield pa.RecordBatch.from_arrays([pa.array(names[good]), pa.array(ids[at[good]]), pa.array(distance[good].astype(float)), pa.array(counts[good])], ["query_id", "id", "distance", "taken"])

    found = pairs.mapInArrow(run, "query_id long, id long, distance double, taken long")
    own = Window.partitionBy("query_id")
    ranked = found.withColumns({"rank": F.row_number().over(own.orderBy("distance", "id")), "n_compared": F.sum("taken").over(own)})
    return ranked.filter(F.col("rank") <= k).drop("taken")
