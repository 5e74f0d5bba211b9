"""Stored conversations, prompts and settings as tables: search, ownership, renaming, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.operators.catalog import latest

LONGEST_NAME = 250


def find_prompts(prompts: DataFrame, prompt_id: str | None = None, filename: str | None = None, text: str | None = None, id_col: str = "id") -> DataFrame:
    """By id; else by file name and text; else by either; else all. Text is a substring."""
    if prompt_id:
        return prompts.filter(F.col(id_col) == prompt_id)
    out = prompts
    if filename:
        out = out.filter(F.col("filename") == filename)
    if text:
        out = out.filter(F.contains("prompt_text", F.lit(text)))
    return out


def owned(histories: DataFrame, user: str, history_id: str | None = None) -> DataFrame:
    """A user's conversations, or one of them."""
    own = histories.filter(F.col("user_id") == user)
    return own if history_id is None else own.filter(F.col("history_id") == history_id)


def renamed(histories: DataFrame, user: str, history_id: str, name: str) -> DataFrame:
    """``histories`` with one conversation's new name; others' rows stay as they are."""
    if not name.strip() or len(name) > LONGEST_NAME:
        raise ValueError(f"a name has 1 to {LONGEST_NAME} characters")
    mine = (F.col("user_id") == user) & (F.col("history_id") == history_id)
    return histories.withColumn("name", F.when(mine, F.lit(name)).otherwise(F.col("name")))


def removed(histories: DataFrame, user: str, history_id: str) -> DataFrame:
    mine = F.coalesce((F.col("user_id") == user) & (F.col("history_id") == history_id), F.lit(False))
    return histories.filter(~mine)


def appended(histories: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages (history_id, question, answer) added at the end of each conversation's list, in order of ``n``."""
    new = messages.groupBy("history_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "question", "answer"))), lambda m: F.struct(m["question"].alias("question"), m["answer"].alias("answer"))).alias("__new"))
    both = histories.join(new, "history_id", "left")
    empty = F.array().cast(histories.schema["messages"].dataType)
    return both.withColumn("messages", F.concat(F.coalesce("messages", empty), F.coalesce("__new", empty))).drop("__new")


def current_settings(snapshots: DataFrame, components: DataFrame) -> DataFrame:
    """Settings that the newest snapshot names: components (ref, name, parameters) by its map of refs."""
    newest = latest(snapshots.withColumn("__all", F.lit(1)), ["__all"], "timestamp", "snapshot_id").select(F.explode("refs").alias("name", "ref"))
    return newest.join(components.select("ref", "parameters"), "ref")


def grid(options: dict[str, list]) -> list[dict]:
    """All combinations of settings."""
    import itertools

    return [dict(zip(options, values)) for values in itertools.product(*options.values())]


def readiness(rows: DataFrame, group: str, ready: Column) -> DataFrame:
    """(group, n, n_ready, status): Ready if all are, Unknown if there are none, else Failed."""
    sums = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(ready).alias("n_ready"))
    return sums.withColumn("status", F.when(F.col("n") == 0, "Unknown").when(F.col("n") == F.col("n_ready"), "Ready").otherwise("Failed"))
