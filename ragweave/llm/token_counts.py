"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch is a table of changes (doc_id, op, source, lang, version, n_tokens): ``+`` adds a document's
count, ``-`` takes it back with the values it was added with, and a revised count is a ``-`` of the
old row and a ``+`` of the new one. A batch is folded into a small signed rollup in its own folder,
whose name is the batch id; a folder that is complete (it has ``_SUCCESS``) is never written again,
so a batch that is sent twice counts once, also after a compaction, which keeps the ids that it folds.
The totals are the sum of all complete rollups.

The rollup pre-aggregates before its shuffle, so one source or language may hold any share of the
rows. Results in special cases: null source, lang or version is a group of its own; null n_tokens
counts as 0 tokens of one document; repeated rows are counted each; a group whose documents are all
taken back has no row; an empty batch is a commit that changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.llm import tokens
from ragweave.llm.common import file_system

KEYS = ("source", "lang", "version")
ROLLUP = "source string, lang string, version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, encoders: dict[str, tuple], text_col: str = "text") -> DataFrame:
    """``docs`` without its text but with n_tokens by the encoder of the row's ``version``.

    ``encoders``: version to ("byte", path, pattern) or ("word", path). Null text has 0 tokens.
    """
    if "n_tokens" in map(str.lower, docs.columns):
        raise ValueError("the input has a column n_tokens already")
    schema = T.StructType([*docs.drop(text_col).schema.fields, T.StructField("n_tokens", T.LongType(), True)])
    encoders = {v: (*e, tokens.merge_ranks(e[1])) if e[0] == "byte" else e for v, e in encoders.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = {"byte": tokens.byte_encoder, "word": tokens.word_encoder}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, versions = part.column(text_col).to_pylist(), part.column("version").to_pylist()
                counts = [0] * len(texts)
                for version in set(versions):
                    own = [i for i, v in enumerate(versions) if v == version]
                    kind, *where = encoders[version]
                    for i, ids in zip(own, make[kind](*where).encode([texts[i] for i in own])):
                        counts[i] = len(ids) // 4
                yield part.drop_columns([text_col]).append_column("n_tokens", pa.array(counts, pa.int64()))

    return docs.mapInArrow(run, schema)


def rollup(changes: DataFrame) -> DataFrame:
    """The signed sums of a batch of changes; groups that come to nothing have no row."""
    sign = F.when(F.col("op") == "-", -1).otherwise(1)
    sums = changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(sign * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
    return sums.filter("n_docs <> 0 or n_tokens <> 0")


def _complete(spark: SparkSession, store: str, kind: str) -> list[str]:
    """Names of the complete folders ``kind=name`` of ``store``, by one listing."""
    fs, make = file_system(spark, store)
    found = fs.globStatus(make(f"{store}/{kind}=*/_SUCCESS"))
    return sorted(x.getPath().getParent().getName().removeprefix(f"{kind}=") for x in found or [])


def _folded(spark: SparkSession, store: str, done: list[str]) -> DataFrame:
    """(batch_id) of the batches that compaction folded into the complete rollups ``done`` of ``store``."""
    paths = [f"{store}/folded={b}" for b in _complete(spark, store, "folded") if b in set(done)]
    if not paths:
        return spark.createDataFrame([], "batch_id string")
    return spark.read.schema("batch_id string").parquet(*paths)


def is_committed(spark: SparkSession, store: str, batch_id: str) -> bool:
    """Whether a batch is in ``store``, by itself or folded into another."""
    done = _complete(spark, store, "batch")
    return batch_id in done or not _folded(spark, store, done).filter(F.col("batch_id") == batch_id).isEmpty()


def commit(changes: DataFrame, store: str, batch_id: str) -> bool:
    """Fold a batch into ``store``; False, and no work, if that batch is there already.

    ``batch_id`` names a folder: letters, digits, ``_``, ``.`` and ``-`` after a letter or digit.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
        raise ValueError(f"a batch can't be called {batch_id!r}")
    spark = changes.sparkSession
    if is_committed(spark, store, batch_id):
        return False
    rollup(changes).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
    return True


def _sums(spark: SparkSession, store: str, done: list[str]) -> DataFrame:
    """n_docs and n_tokens by source, lang and version over the batches ``done``."""
    if not done:
        return spark.createDataFrame([], ROLLUP)
    rows = spark.read.schema(ROLLUP).parquet(*[f"{store}/batch={b}" for b in done])
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """n_docs and n_tokens by source, lang and version over all complete batches."""
    return _sums(spark, store, _complete(spark, store, "batch"))


def compact(spark: SparkSession, store: str, target: str, name: str = "compacted") -> None:
    """Write the totals of ``store`` as the batch ``name`` of a new store, to which later batches go.

    The batches are listed once, and exactly those are summed and named as folded: a batch that is committed
    meanwhile is in neither and can be sent to ``target``. The ids are written before the sums and count
    once these are complete, so a batch that is sent again after the compaction changes nothing, and
    neither does a compaction that is repeated.
    """
    if is_committed(spark, target, name):
        return
    done = _complete(spark, store, "batch")
    own = spark.createDataFrame([(b,) for b in done], "batch_id string")
    own.unionByName(_folded(spark, store, done)).write.mode("overwrite").parquet(f"{target}/folded={name}")
    _sums(spark, store, done).write.mode("overwrite").parquet(f"{target}/batch={name}")
