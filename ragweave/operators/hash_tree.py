"""Synchronisation by hash trees: two listings are compared by digests, and only leaves that differ are read.

A listing is kept under a folder: its rows in one folder per leaf, a leaf being a range of the hash of the key, and a
table of digests by level, from the leaves up to the root. A digest is the number of rows below a node and two
sums of their hashes modulo 2 ** 64, so it doesn't depend on the order and can be updated by
adding and subtracting. Two trees are compared from the root down, one small join per level, only below nodes that
differ; the rows of the leaves that are left are then compared for real.

Digests of equal rows are equal always; different rows with equal digests of 128 bits would go unnoticed. Rows that
repeat count each; null fields count as values; an empty listing has no leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.operators import catalog
from ragweave.storage import materialize

#: Children of a node, and levels below the root: FANOUT ** DEPTH leaves.
FANOUT, DEPTH = 16, 3
KEYS = ("bucket_name", "object_name")


def _leaf(keys: tuple[str, ...], fanout: int, depth: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(fanout**depth)).cast("int")


def _digests(rows: DataFrame, fields: list[str], depth: int, fanout: int) -> DataFrame:
    """(level, node, n, a, b) of all nodes above the rows, which have their ``leaf``."""
    wide = lambda *salt: F.xxhash64(*salt, *[F.struct(F.col(f"`{c}`"), F.col(f"`{c}`").isNull()) for c in fields]).cast("decimal(38,0)")
    low = lambda c: F.pmod(F.sum(c), F.lit("18446744073709551616").cast("decimal(38,0)")).cast("decimal(20,0)")
    each = rows.select("leaf", wide().alias("a"), wide(F.lit("b")).alias("b"))
    level = materialize(each.groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("n"), low("a").alias("a"), low("b").alias("b")), "leaf-digests")
    out = level.select(F.lit(depth).alias("level"), "node", "n", "a", "b")
    for d in range(depth - 1, -1, -1):
        level = level.groupBy(F.floor(F.col("node") / fanout).cast("int").alias("node")).agg(F.sum("n").alias("n"), low(F.col("a").cast("decimal(38,0)")).alias("a"), low(F.col("b").cast("decimal(38,0)")).alias("b"))
        out = out.unionByName(level.select(F.lit(d).alias("level"), "node", "n", "a", "b"))
    return out


def keep(rows: DataFrame, path: str, keys: tuple[str, ...] = KEYS, fields: tuple[str, ...] = ("etag", "size"), fanout: int = FANOUT, depth: int = DEPTH) -> None:
    """Write a listing and its tree under ``path``: rows by leaf, digests by level."""
    dealt = rows.select(*keys, *fields).withColumn("leaf", _leaf(keys, fanout, depth))
    dealt.repartition("leaf").sortWithinPartitions("leaf").write.partitionBy("leaf").parquet(f"{path}/rows")
    spark = rows.sparkSession
    schema = dealt.select(*keys, *fields, "leaf").schema
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    _digests(stored, [*keys, *fields], depth, fanout).coalesce(1).write.partitionBy("level").parquet(f"{path}/tree")
    spark.createDataFrame([(fanout, depth)], "fanout int, depth int").coalesce(1).write.parquet(f"{path}/shape")


TREE = "node int, n long, a decimal(20,0), b decimal(20,0), level int"


def differing_leaves(spark: SparkSession, ours: str, theirs: str) -> list[int]:
    """Leaves whose digests differ, found from the root down; at most FANOUT ** DEPTH numbers."""
    shapes = [tuple(spark.read.parquet(f"{p}/shape").first()) for p in (ours, theirs)]
    if shapes[0] != shapes[1]:
        raise ValueError(f"the trees have different shapes {shapes}")
    fanout, depth = shapes[0]
    trees = [spark.read.schema(TREE).parquet(f"{p}/tree") for p in (ours, theirs)]
    nodes: list[int] = [0]
    for level in range(depth + 1):
        a, b = (t.filter((F.col("level") == level) & F.col("node").isin(nodes)).select("node", F.struct("n", "a", "b").alias(x)) for t, x in zip(trees, ("ours", "theirs")))
        found = a.join(b, "node", "full_outer").filter(~F.col("ours").eqNullSafe(F.col("theirs"))).select("node").collect()
        nodes = sorted(r.node for r in found)
        if not nodes or level == depth:
            return nodes
        nodes = [n * fanout + i for n in nodes for i in range(fanout)]
    return nodes


def _rows(spark: SparkSession, path: str, leaves: list[int], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/rows").filter(F.col("leaf").isin(leaves)).drop("leaf")


def changes(spark: SparkSession, storage: str, known: str, schema: str = "bucket_name string, object_name string, etag string, size long", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Objects to add, update or delete so that the kept listing ``known`` follows ``storage``; equal leaves aren't read."""
    leaves = differing_leaves(spark, storage, known)
    full = f"{schema}, leaf int"
    there, here = (_rows(spark, p, leaves, full) for p in (storage, known))
    return catalog.sync(there, here, keys).filter("action <> 'no action'")
