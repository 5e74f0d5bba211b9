"""The file and link catalogue: status metrics, storage synchronisation, soft deletes, event replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The states of a file or link.
STATUSES = ("uploaded", "error", "processing", "text_extracting", "text_compression", "text_splitting", "dpguard", "late_chunking", "embedding", "ingested", "deleting", "canceled", "blocked")


def is_marker(object_col: str = "object_name", type_col: str = "content_type", size_col: str = "size") -> Column:
    """Directory markers: a name that ends in a slash, a directory type, or no bytes."""
    return F.coalesce(F.col(object_col).endswith("/"), F.lit(False)) | F.coalesce(F.lower(type_col).contains("directory"), F.lit(False)) | F.coalesce(F.col(size_col) == 0, F.lit(False))


def sync(storage: DataFrame, catalog: DataFrame, keys: tuple[str, ...] = ("bucket_name", "object_name")) -> DataFrame:
    """One row per object on either side with ``action``: add, update, delete or no action."""
    here = catalog.select(*keys, F.col("etag").alias("old_etag"), F.col("size").alias("old_size"), F.lit(True).alias("listed"))
    there = storage.select(*keys, "etag", "size", F.lit(True).alias("stored"))
    changed = ~F.col("etag").eqNullSafe(F.col("old_etag")) | ~F.col("size").eqNullSafe(F.col("old_size"))
    action = F.when(F.col("listed").isNull(), "add").when(F.col("stored").isNull(), "delete").when(changed, "update").otherwise("no action")
    return there.join(here, list(keys), "full_outer").withColumn("action", action).drop("listed", "stored")


def gone(catalog: DataFrame, storage: DataFrame, keys: tuple[str, ...] = ("bucket_name", "object_name")) -> DataFrame:
    """Catalogue rows without an object in storage."""
    return catalog.join(storage.select(*keys), list(keys), "left_anti")


def status_counts(rows: DataFrame, spark: SparkSession, statuses: tuple[str, ...] = STATUSES, status: str = "status") -> DataFrame:
    """(status, n) for every known status, zero included; deleted rows count."""
    names = spark.createDataFrame([(s,) for s in statuses], "status string")
    counts = rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def totals(rows: DataFrame, deleted: str = "marked_for_deletion") -> DataFrame:
    """Counts of live and deleted rows, and chunks in all and processed."""
    return rows.agg(
        F.count_if(~F.coalesce(F.col(deleted), F.lit(False))).alias("n_live"),
        F.count_if(F.coalesce(F.col(deleted), F.lit(False))).alias("n_deleted"),
        F.coalesce(F.sum("chunks_total"), F.lit(0)).cast("long").alias("chunks_total"),
        F.coalesce(F.sum("chunks_processed"), F.lit(0)).cast("long").alias("chunks_processed"),
    )


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def changes_only(rows: DataFrame, keys: list[str], at: str, tie: str, value: str) -> DataFrame:
    """Rows whose value differs from the key's row before; the first of a key stays."""
    line = Window.partitionBy(*keys).orderBy(at, tie)
    return rows.withColumns({"__n": F.row_number().over(line), "__before": F.lag(value).over(line)}).filter((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__n", "__before")


def replaced(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Soft-delete the older rows of incoming keys and add the incoming rows as uploaded."""
    fresh = incoming.withColumns({"status": F.lit("uploaded"), "marked_for_deletion": F.lit(False)})
    marked = current.join(incoming.select(*keys).distinct().withColumn("__new", F.lit(True)), keys, "left")
    older = marked.withColumn("marked_for_deletion", F.coalesce(F.col("__new"), F.col("marked_for_deletion"), F.lit(False))).drop("__new")
    return older.unionByName(fresh, allowMissingColumns=True)


def retried(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows named in ``ids`` start again: no progress, uploaded, no times."""
    named = rows.join(ids.select(id_col).distinct().withColumn("__again", F.lit(True)), id_col, "left")
    reset = {c: F.when(F.col("__again"), F.lit(v)).otherwise(F.col(c)) for c, v in (("status", "uploaded"), ("chunks_total", 0), ("chunks_processed", 0)) if c in rows.columns}
    return named.withColumns(reset).select(*rows.columns)
