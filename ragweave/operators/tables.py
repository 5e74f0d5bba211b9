"""Vector tables on Parquet: append, delete by metadata, replace a file's rows."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.storage import discard, file_system, materialize, remove

#: Touched partitions that are broadcast to find their rows; more are joined.
MOST_TOUCHED = 10_000


def table_name(model: str, algorithm: str, dtype: str, metric: str, dims: int) -> str:
    """The name that follows from the schema: another model or size is another table."""
    return f"{model}_{algorithm}_{dtype}_{metric}_{dims}_index".replace("/", "_").replace("-", "_").lower()


def plain_id(value: str) -> str:
    return value.replace("-", "")


class VectorTable:
    """Rows in one folder, partitioned by ``partition``; a change rewrites only the partitions that it touches.

    What a change writes is first a table of its own in the shared folder and then replaces the touched
    partitions by a dynamic overwrite, whose files Spark moves into place when all tasks have ended. A change
    that fails before leaves the old rows; one that is repeated gives the same rows. Changes of one table are
    made one after another, as by the stream or job that owns it.
    """

    def __init__(self, spark: SparkSession, path: str, partition: str = "bucket_name"):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    def read(self) -> DataFrame | None:
        """The rows, or None if nothing was ever written."""
        fs, make = file_system(self.spark, self.path)
        if not fs.exists(make(self.path)) or not fs.globStatus(make(f"{self.path}/{self.partition}=*")):
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Add rows; only they are written."""
        self._spread(rows).write.mode("append").partitionBy(self.partition).parquet(self.path)

    def delete(self, field: str, value: str) -> None:
        """Drop the rows whose ``field`` names ``value``."""
        rows = self.read()
        if rows is not None:
            gone = F.coalesce(F.col(field) == plain_id(value), F.lit(False))
            self._rewrite(rows, rows.filter(gone), lambda held: held.filter(~gone), None)

    def upsert(self, rows: DataFrame, key: str = "file_id") -> None:
        """Replace all rows of the incoming keys."""
        now = self.read()
        if now is None:
            self.append(rows)
            return
        incoming = materialize(rows, "upsert")
        keys = incoming.select(key).distinct()
        self._rewrite(now, now.join(keys, key, "left_semi"), lambda held: held.join(keys, key, "left_anti"), incoming)
        discard(incoming)

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Few files a partition, and more tasks for a large one: AQE splits what is too large and joins the rest."""
        return rows.hint("rebalance", self.partition)

    def _rewrite(self, rows: DataFrame, found: DataFrame, change: Callable[[DataFrame], DataFrame], more: DataFrame | None) -> None:
        """Write the partitions of ``found`` (and of ``more``, which is added) anew, with ``change`` applied to their rows."""
        name = F.col(self.partition)
        touched = found.select(name.alias("__at")).union(more.select(name.alias("__at")) if more is not None else found.select(name).limit(0)).distinct()
        touched = materialize(touched, "touched")
        held = rows.join(F.broadcast(touched) if touched.count() <= MOST_TOUCHED else touched, name.eqNullSafe(F.col("__at")), "left_semi")
        folders = held.select(name.alias("__at"), F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("__folder")).distinct()
        folders = materialize(folders, "touched-folders")
        left = change(held)
        left = materialize(left if more is None else left.unionByName(more, allowMissingColumns=True), "rewritten")
        self._spread(left).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(self.path)
        for row in folders.join(left.select(name.alias("__left")).distinct(), F.col("__at").eqNullSafe(F.col("__left")), "left_anti").select("__folder").toLocalIterator():
            remove(self.spark, unquote(row[0]))
        for table in (touched, folders, left):
            discard(table)


def check_delete(file_id: str | None, link_id: str | None) -> tuple[str, str]:
    """Which field and value a delete request names."""
    if file_id:
        return "file_id", plain_id(file_id)
    if link_id:
        return "link_id", plain_id(link_id)
    raise ValueError("file_id or link_id is needed")


def resume(queries: DataFrame, done: DataFrame, key: str = "uuid") -> DataFrame:
    """What isn't in the checkpoint yet."""
    return queries.join(done.select(key), key, "left_anti")
