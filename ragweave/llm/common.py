"""Shared helpers: tables written to the shared folder, Arrow text buffers, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.storage import BATCH_BYTES, discard, file_system, materialize, scratch, shared_dir, small_batches  # noqa: F401


#: Keys of a join that may count as hot: those with over this fraction of all rows, so there are fewer.
HOT_KEYS = 1000


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The ``rows`` whose key is in the written table ``keys`` (``on``, and ``n``, the rows of each key).

    Keys with over a thousandth of all counted rows, of which there are less than a thousand, are
    broadcast, so their rows aren't shuffled; the others meet by an ordinary join.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = keys.filter(F.col("n") > total / HOT_KEYS).select(*on)
    rest = keys.filter(F.col("n") <= total / HOT_KEYS).select(*on)
    if hot.isEmpty():
        return rows.join(rest, on, "left_semi")
    hot = F.broadcast(hot)
    return rows.join(hot, on, "left_semi").unionByName(rows.join(hot, on, "left_anti").join(rest, on, "left_semi"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def first_as_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``: the one whose columns come first as JSON text."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    picked = rows.groupBy(*[F.col(f"`{k}`").alias(f"__key_{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, F.to_json(whole)).alias("__row"))
    return picked.select("__row.*")


def text_views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """One string or binary column as (bytes, offsets) without copying rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about ``most`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def large_star(both: DataFrame, low: DataFrame) -> DataFrame:
    """Larger neighbours (u, v) of each node linked to the smallest node (u, m) around it."""
    return both.filter("v > u").join(low, "u").selectExpr("v u", "m v").filter("u <> v")


def small_star(large: DataFrame, least: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, linked to the smallest of them (u, m)."""
    links = large.join(least, "u").filter("v <> m").selectExpr("greatest(v, m) u", "least(v, m) v")
    return links.union(least.selectExpr("u", "m v")).filter("u <> v")


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``edges`` (u, v longs).

    Alternating large-star and small-star rounds, until nothing changes. The minimum of a node's neighbours is
    pre-aggregated and written before its neighbours are joined with it, so both sides of that join are plain
    exchanges and Spark splits the rows of a hub over several tasks.
    """
    cur = materialize(edges.filter("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), name)
    seal = None
    while True:
        both = cur.union(cur.selectExpr("v", "u"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m"), f"{name}-low")
        large = materialize(large_star(both, low).distinct(), f"{name}-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        last, cur = cur, materialize(small_star(large, least).distinct(), name)
        for table in (last, low, large, least):
            discard(table)
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seal:
            break
        seal = now
    roots = cur.select(F.col("v").alias("node")).distinct().selectExpr("node", "node component")
    return cur.selectExpr("u node", "v component").union(roots)
