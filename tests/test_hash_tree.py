"""Hash trees: what differs is found, and equal leaves aren't read."""

import pytest
from pyspark.sql import functions as F

from ragweave.operators import catalog, hash_tree
from ragweave.storage import fresh_path


def listing(spark, n=3000):
    return spark.range(n).select((F.col("id") % 3).cast("string").alias("bucket_name"), F.concat(F.lit("o"), "id").alias("object_name"), F.md5(F.col("id").cast("string").cast("binary")).alias("etag"), F.col("id").alias("size"))


def kept(spark, rows):
    path = fresh_path(spark, "tree")
    hash_tree.keep(rows, path, depth=2)
    return path


def test_one_changed_object_reads_few_rows(spark):
    rows = listing(spark)
    one = rows.withColumn("etag", F.when(F.col("object_name") == "o77", "new").otherwise(F.col("etag")))
    a, b = kept(spark, rows), kept(spark, one)
    assert hash_tree.differing_leaves(spark, a, kept(spark, rows.repartition(5))) == []
    leaves = hash_tree.differing_leaves(spark, a, b)
    assert len(leaves) == 1
    read = hash_tree._rows(spark, a, leaves, "bucket_name string, object_name string, etag string, size long, leaf int").count()
    assert read < 3000 / 50
    assert [(r.object_name, r.action) for r in hash_tree.changes(spark, a, b).collect()] == [("o77", "update")]


def test_changes_equal_a_full_comparison(spark):
    rows = listing(spark)
    storage = rows.filter("size % 101 <> 0").unionByName(spark.createDataFrame([(None, "x", None, None), ("1", None, "e", 1)], "bucket_name string, object_name string, etag string, size long"))
    known = rows.filter("size % 97 <> 0").withColumn("size", F.when(F.col("size") % 89 == 0, None).otherwise(F.col("size")))
    got = hash_tree.changes(spark, kept(spark, storage), kept(spark, known)).select("bucket_name", "object_name", "action")
    want = catalog.sync(storage, known).filter("action <> 'no action'").select("bucket_name", "object_name", "action")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_listings_and_other_shapes(spark):
    rows = listing(spark, 20)
    empty, full = kept(spark, rows.limit(0)), kept(spark, rows)
    assert {r.action for r in hash_tree.changes(spark, full, empty).collect()} == {"add"}
    assert {r.action for r in hash_tree.changes(spark, empty, full).collect()} == {"delete"}
    assert hash_tree.changes(spark, empty, kept(spark, rows.limit(0))).count() == 0
    other = fresh_path(spark, "tree")
    hash_tree.keep(rows, other, depth=1)
    with pytest.raises(ValueError):
        hash_tree.changes(spark, full, other)
