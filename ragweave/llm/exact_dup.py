"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A frequent-items sketch of the Misra-Gries family (``approx_top_k``) reads the digests where they are and
names prefixes that may be frequent; sketches of tasks meet in a tree, so no task merges all of them. A
pre-aggregated exact pass over whole digests verifies the candidates and gives each one's winner. At most
``k * digests of a prefix`` winners are broadcast and settle their rows where they were read: rows of heavy
digests are never shuffled. The other digests are shuffled once to a table of those that occur twice, and
an ordinary join gives it back to their rows; both sides of it are plain exchanges of Parquet, so Spark
can split a digest that the sketch left out and still has many rows.

Results in special cases: null text counts as empty text; a null doc_id loses to any other; every row
counts, also one that repeats another's doc_id and text, and is kept like it; an empty table gives an
empty result; further columns are ignored by ``annotate_copies`` and kept by ``drop_copies``, which of
kept rows with equal id and text takes the one whose columns come first as JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import first_as_json, free_name, materialize

#: Candidates at most, counters of a sketch, and sketches merged in the tree's middle.
HEAVY, COUNTERS, MIDDLE = 256, 2048, 64


def _digest(text: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def heavy_winners(digests: DataFrame, k: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """(text_sha256, heavy_id, heavy_size) of the sketch's candidates, counted exactly.

    The sketch works on 60-bit prefixes, of which it names at most ``k``; equal prefixes of different
    digests would only add a row.
    """
    head = F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long")
    keyed = digests.withColumn("__head", head)
    part = keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(MIDDLE)).alias("p")).agg(F.expr(f"approx_top_k_accumulate(__head, {counters})").alias("s"))
    found = part.groupBy(F.lit("all").alias("all")).agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {k})")).alias("top")).select(F.col("top.item").alias("__head"))
    return keyed.join(F.broadcast(found), "__head", "left_semi").groupBy("text_sha256").agg(F.max("doc_id").alias("heavy_id"), F.count("*").alias("heavy_size"))


def _split(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of heavy rows with their winner, the other digests, and (text_sha256, best_id, size) of those that repeat."""
    digests = materialize(docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("text_sha256")), "digests")
    winners = materialize(heavy_winners(digests, k), "winners")
    marked = digests.join(F.broadcast(winners), "text_sha256", "left")
    light = marked.filter("heavy_size is null").select("doc_id", "text_sha256")
    groups = light.groupBy("text_sha256").agg(F.max("doc_id").alias("best_id"), F.count("*").alias("size")).filter("size > 1")
    return marked.filter("heavy_size is not null"), light, materialize(groups, "copy-groups")


def annotate_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    heavy, light, groups = _split(docs, id_col, text_col, k)
    heavy = heavy.select("doc_id", F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"), "text_sha256")
    alone = F.col("size").isNull()
    light = light.join(groups, "text_sha256", "left").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"), F.when(alone, F.lit(1)).otherwise(F.col("size")).cast("long").alias("group_size"), "text_sha256")
    both = heavy.unionByName(light).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return both.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY) -> DataFrame:
    """``docs`` without the rows whose text another row with a larger id has; all columns stay.

    Rows of heavy digests are dropped where they are read, by the broadcast winners. Of the others, only ids
    and digests of those to drop are joined back, so a text moves once, and not at all where Spark broadcasts
    that list under its own size check. Kept rows that repeat both id and text, if there are any, are joined
    and reduced to one apart from the others.
    """
    sha, other, digest = (free_name(docs, x) for x in ("sha", "other_id", "other_sha"))
    heavy, light, groups = _split(docs, id_col, text_col, k)
    best = heavy.filter(F.col("doc_id").eqNullSafe(F.col("heavy_id"))).groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    winners = materialize(best.select(F.col("text_sha256").alias(digest), F.col("doc_id").alias(other)), "kept-heavy")
    grouped = light.join(groups, "text_sha256")
    named = lambda rows: rows.select(F.col("doc_id").alias(other), F.col("text_sha256").alias(digest))
    gone = materialize(named(grouped.filter(~F.col("doc_id").eqNullSafe(F.col("best_id")))), "copies")
    again = grouped.filter(F.col("doc_id").eqNullSafe(F.col("best_id"))).groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    repeats = materialize(named(again.unionByName(best).filter("n > 1")), "kept-repeats")
    same = F.col(id_col).eqNullSafe(F.col(other)) & (F.col(sha) == F.col(digest))
    tagged = docs.withColumn(sha, _digest(text_col)).join(F.broadcast(winners), F.col(sha) == F.col(digest), "left")
    tagged = tagged.filter(F.col(digest).isNull() | F.col(id_col).eqNullSafe(F.col(other))).drop(other, digest)
    once = tagged.join(gone, same, "left_anti")
    if repeats.isEmpty():
        return once.drop(sha)
    repeated = first_as_json(once.join(repeats, same, "left_semi"), [id_col, sha])
    return once.join(repeats, same, "left_anti").unionByName(repeated).drop(sha)
