"""Prompt assembly: templates, context with citations, conversation history."""

from __future__ import annotations

from collections.abc import Sequence

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragweave.operators import ranges

PLACEHOLDER = re.compile(r"\{(\w+)\}")
OPTIONAL = "conversation_history"
# Fixed value: the answer that stands for a blocked one in stored conversations.
BLOCKED = "I'm sorry, I cannot assist you with your prompt."
# Labels of the turns by language.
LABELS = {"en": ("User", "Assistant"), "pl": ("Użytkownik", "Asystent")}


def check_template(template: str, expected: Iterable[str]) -> None:
    """Raise ValueError unless ``template`` has each expected placeholder once and no other."""
    found, expected = PLACEHOLDER.findall(template), set(expected)
    if missing := expected - set(found) - {OPTIONAL}:
        raise ValueError(f"missing placeholders: {sorted(missing)}")
    if extra := set(found) - expected - {OPTIONAL}:
        raise ValueError(f"unexpected placeholders: {sorted(extra)}")
    if twice := {x for x in found if found.count(x) > 1}:
        raise ValueError(f"repeated placeholders: {sorted(twice)}")


def changed_template(current: str, new: str | None, expected: Iterable[str]) -> str:
    """``new`` if it is valid and differs, else ``current``."""
    if not new or new == current:
        return current
    check_template(new, expected)
    return new


def render(template: str, values: dict[str, Column | str]) -> Column:
    """The template with each placeholder replaced by a column; null counts as empty."""
    parts, at = [], 0
    for m in PLACEHOLDER.finditer(template):
        if m[1] not in values and m[1] != OPTIONAL:
            raise ValueError(f"no value for {m[1]}")
        value = values.get(m[1], F.lit(""))
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))]
        at = m.end()
    return F.trim(F.concat(*parts, F.lit(template[at:])))


def context_entry(citation: str = "citation_id", source: str = "source", text: str = "text", headers: Iterable[str] = ()) -> Column:
    """``[1] (source)``, section and content lines of one document; section and text alone if the source is unknown."""
    section = F.concat_ws(" > ", *headers) if headers else F.lit("")
    head = F.format_string("[%d] (%s)", F.col(citation), F.col(source))
    lines = F.concat_ws("\n", head, F.when(section != "", F.concat(F.lit("Section: "), section)), F.concat(F.lit("Content: "), F.col(text)))
    bare = F.concat(F.when(section != "", F.concat(F.lit("\nSection: "), section)).otherwise(""), F.col(text))
    return F.when(F.col(source).isNull() | (F.col(source) == ""), bare).otherwise(lines)


def context(rows: DataFrame, entry: Column, group: str = "query_id", rank: str = "rank") -> DataFrame:
    """(group, context): the entries of a group in order of rank, with blank lines between."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), entry.alias("e"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["e"]), "\n\n").alias("context"))


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn whose next turn is the assistant's."""
    line = Window.partitionBy("conv_id").orderBy("turn")
    ahead = turns.withColumns({"next_role": F.lead("role").over(line), "answer": F.lead("text").over(line)})
    return ahead.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def recent(pairs: DataFrame, k: int = 3, refusals: Iterable[str] = (BLOCKED,)) -> DataFrame:
    """The last ``k`` exchanges of each conversation, without those whose answer is a refusal."""
    kept = pairs.filter(~F.coalesce(F.col("answer").isin(list(refusals)), F.lit(False))) if refusals else pairs
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return kept.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= k)


def history(pairs: DataFrame, k: int = 3, language: str = "en", refusals: Iterable[str] = (BLOCKED,)) -> DataFrame:
    """(conv_id, history): the last exchanges as labelled lines, oldest first."""
    user, assistant = LABELS[language]
    line = F.concat(F.lit(f"{user}: "), F.coalesce("question", F.lit("")), F.lit(f"\n{assistant}: "), F.coalesce("answer", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return recent(pairs, k, refusals).groupBy("conv_id").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("history"))


def translation_languages(rows: DataFrame, question: str = "question_lang", answer: str = "answer_lang") -> DataFrame:
    """source_lang and target_lang of a translation: to the question's language; equal ones start from English."""
    return rows.withColumns({"target_lang": F.col(question), "source_lang": F.when(F.col(question) == F.col(answer), F.lit("en")).otherwise(F.col(answer))})


def with_next(rows: DataFrame, order: str, value: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the next row of its ``group`` by a numeric ``order``; null at the end."""
    return ranges.with_neighbours(rows, group, order, value, "__previous_value", name).drop("__previous_value")
