"""Reranking: best scores above a threshold, neighbours merged into a hit, citation numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.operators import ranges
from ragweave.storage import materialize


def top_scored(rows: DataFrame, n: int, threshold: float | None = None, group: str = "query_id", score: str = "score", position: str = "position") -> DataFrame:
    """The ``n`` best of each group (ties: earlier position), then those strictly above ``threshold``."""
    best = Window.partitionBy(group).orderBy(F.desc(score), position)
    out = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    return out if threshold is None else out.filter(F.col(score) > threshold)


def answerable(rows: DataFrame, prompt: str = "query", text: str = "text", group: str = "query_id") -> DataFrame:
    """``rows`` as a reranking request takes them: a blank prompt is an error, one empty text leaves its query without rows."""
    blank = F.assert_true(F.length(F.trim(F.coalesce(F.col(prompt), F.lit("")))) > 0, F.lit("a prompt can't be blank"))
    checked = rows.filter(blank.isNull())
    empty = F.col(text).isNull() | (F.col(text) == "")
    lost = materialize(checked.groupBy(F.col(group).alias("__group")).agg(F.max(empty).alias("lost")).filter("lost"), "without-text")
    return checked.join(lost, F.col(group).eqNullSafe(F.col("__group")), "left_anti")


def top_or_all(rows: DataFrame, n: int, threshold: float | None = None, group: str = "query_id", score: str = "score", position: str = "position") -> DataFrame:
    """As ``top_scored``; a query for which the scorer gave no number at all keeps its rows as they came, ranked by position."""
    given = materialize(rows.groupBy(F.col(group).alias("__group")).agg(F.count(score).alias("given")).filter("given = 0"), "unscored")
    same = F.col(group).eqNullSafe(F.col("__group"))
    kept = rows.join(given, same, "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(position)))
    return top_scored(rows.join(given, same, "left_anti"), n, threshold, group, score, position).unionByName(kept)


def scored(rows: DataFrame, score: Callable[[list[str], list[str]], Sequence[float]], query: str = "query", text: str = "text", out: str = "score", batch: int = 32, logits: bool = False) -> DataFrame:
    """``rows`` with the scorer's number for each (query, text), in batches; ``logits`` go through a sigmoid.

    The scorer is a model behind a callable, as a cross-encoder: lists of queries and texts in, scores out.
    Null counts as empty; an empty answer for a batch gives null, which ``top_or_all`` understands.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                asked, texts = ([x or "" for x in part.column(c).to_pylist()] for c in (query, text))
                found = np.asarray(score(asked, texts), float)
                if not len(found):
                    yield part.append_column(out, pa.nulls(part.num_rows, pa.float64()))
                    continue
                if len(found) != part.num_rows:
                    raise ValueError("a scorer gives one number for each pair")
                yield part.append_column(out, pa.array(1 / (1 + np.exp(-found)) if logits else found))

    return rows.mapInArrow(run, schema)


def top_near(rows: DataFrame, n: int, group: str = "query_id", distance: str = "distance", position: str = "position") -> DataFrame:
    """The ``n`` nearest of each group; a missing distance is the farthest."""
    best = Window.partitionBy(group).orderBy(F.coalesce(F.col(distance).cast("double"), F.lit(float("inf"))), position)
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def cite(rows: DataFrame, source: Column | str, group: str = "query_id", rank: str = "rank") -> DataFrame:
    """``rows`` with citation_id: sources numbered by first appearance; rows without a source share one number.

    First ranks are aggregated before the shuffle and numbered by ranges, so a query may have any number of rows.
    """
    key = F.coalesce((F.col(source) if isinstance(source, str) else source).cast("string"), F.lit(""))
    named = rows.withColumn("__source", key)
    firsts = materialize(named.groupBy(F.col(group).alias("__group"), F.col("__source").alias("__name")).agg(F.min(rank).alias("__first")), "first-ranks")
    numbers = materialize(ranges.numbered(firsts, ["__group"], "__first", "__name", "citation_id").drop("__first"), "citations")
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__source") == F.col("__name"))
    return named.join(numbers, same).withColumn("citation_id", F.col("citation_id").cast("int")).drop("__source", "__group", "__name")


def as_sources(rows: DataFrame, group: str = "query_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """(group, sources): the reranked rows of each query as structs, in order: a file's bucket and object, or a link's url."""
    source = F.struct(F.col(rank).alias("rank"), F.when(F.col("url").isNull(), "file").otherwise("link").alias("type"), "bucket_name", "object_name", "url", "citation_id", F.col(text).alias("text"))
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(source)).alias("sources"))


def merge_siblings(hits: DataFrame, siblings: DataFrame, group: str = "query_id", hit: str = "hit_id", rank: str = "rank", start: str = "start_index", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per hit: its text and its siblings' in order of start, joined by spaces; later equal texts go.

    With ``digest``, combined_md5 and combined_length instead of combined_text, so that long texts aren't dealt out again.
    """
    parts = hits.select(group, hit, rank, start, text).unionByName(siblings.join(hits.select(group, hit, rank), [group, hit]).select(group, hit, rank, start, text))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(start), F.lit(0)).alias("s"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    merged = parts.groupBy(group, hit, rank).agg(joined.alias("combined_text"))
    if digest:
        merged = merged.select(group, hit, rank, F.md5(F.col("combined_text").cast("binary")).alias("combined_md5"), F.length("combined_text").cast("long").alias("combined_length"))
    first = F.row_number().over(Window.partitionBy(group, "combined_md5" if digest else "combined_text").orderBy(rank))
    return merged.withColumn("n", first).filter("n = 1").drop("n")
