"""The corpus pipeline: language ID, exact dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. ``run`` writes
every stage's result as Parquet to the shared folder and reads it again for the next one. Tables that a
stage wrote for itself are deleted when another stage of the same session begins, unless its input still
reads them: a stage's result must be written before the next stage is built, as ``run`` does. Results of
one stage for several inputs may be held at once.

Results in special cases, beside those of the operators: documents with null or letterless text go in the
first stage; of rows with equal text the largest doc_id stays, null ids last; of near copies the smallest;
rows that repeat id and text are one document; a text that loses all its bytes stays as an empty document;
further columns stay until packing, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ragweave.llm import exact_dup, language_id, near_dup, packing, repeats
from ragweave.llm.common import discard, materialize, scratch, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: By stage, the tables that it wrote for itself.
_left: dict[str, list[DataFrame]] = {}


def _folders(docs: DataFrame) -> str:
    """The folders that the plan of ``docs`` reads; not their files, of which there may be millions."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return " ".join(x.relation().location().rootPaths().mkString(" ") for x in found if x.nodeName().startswith("LogicalRelation") or x.nodeName().startswith("Relation"))


def _discard_others(spark: SparkSession, docs: DataFrame, name: str) -> None:
    """Delete what other stages of this session have left and ``docs`` doesn't read."""
    others = [k for k, tables in _left.items() if k != name and tables]
    read = _folders(docs) if others else ""
    for k in others:
        for table in _left.pop(k):
            if table.sparkSession.sparkContext is spark.sparkContext and table._ragweave_path.rpartition("/")[2] not in read:
                discard(table)


def _stage(name: str, work: Callable[[DataFrame], DataFrame]) -> tuple[str, Stage]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _discard_others(spark, docs, name)
        small_batches(spark)
        with scratch() as own:
            out = work(docs)
        _left.setdefault(name, []).extend(own)
        return out

    return name, run


def identified(docs: DataFrame) -> DataFrame:
    """Documents with a language; learned from those that are labelled."""
    return language_id.keep_identified(docs, language_id.train(docs))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document, the smallest id, of each class of near copies by five-word shingles."""
    return near_dup.keep_one(docs, k=5)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    _stage("language_id", identified),
    _stage("exact_dedup", exact_dup.drop_copies),
    _stage("near_dedup", without_near_copies),
    _stage("suffix_array_dedup", repeats.cut_repeats),
    _stage("best_fit_packing", packed),
]

#: The stages aren't expressible in SQL; a test compares them with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
