"""Tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset it is an error on a cluster, whose machines share no folder of their own; a local
    session, as in tests, gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ragweave-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/ragweave/{name}-{uuid.uuid4().hex}"


#: Lists that ``scratch`` blocks fill with the tables written inside them.
_SCRATCH: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects the tables that ``materialize`` writes inside, for ``discard`` once nothing reads them."""
    own: list[DataFrame] = []
    _SCRATCH.append(own)
    try:
        yield own
    finally:
        _SCRATCH.remove(own)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back, which cuts its lineage.

    The files survive a lost executor, so whatever reads them never recomputes ``df``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ragweave_path = path
    for own in _SCRATCH:
        own.append(out)
    return out


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, unless the session says otherwise than Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, BATCH_BYTES)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of ``path``, and what makes its path objects."""
    sc = spark.sparkContext
    make = sc._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(sc._jsc.hadoopConfiguration()), make


def remove(spark: SparkSession, path: str) -> None:
    fs, make = file_system(spark, path)
    fs.delete(make(path), True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    path = getattr(df, "_ragweave_path", None)
    if path:
        remove(df.sparkSession, path)
