"""Many terms in one pass: a deterministic automaton over texts, so that the cost doesn't grow with the number of terms.

The terms become one Aho-Corasick automaton per worker, built once and kept. A text is walked once; each place where
a term ends is judged by the whole-word rule there, case is folded before the walk. Of matches that overlap, redaction
takes the leftmost and of these the longest, so what stays doesn't depend on the order of the terms.

Folding is by single characters that keep their number, as places are those of the text; a word character is a letter,
a digit or the underscore. Null texts have no matches; empty terms are an error, repeated ones count once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"
MATCH = T.StructType([T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def folded(text: str) -> str:
    """``text`` in lower case, without the characters whose lower case has another length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@functools.lru_cache(4)
def _automaton(terms: tuple[str, ...], case_sensitive: bool) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for t in terms:
        out.add_word(t if case_sensitive else folded(t), len(t))
    out.make_automaton()
    return out


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end of a match."""
    word = lambda i: text[i].isalnum() or text[i] == "_"
    return not (start and word(start - 1) and word(start)) and not (end < len(text) and word(end) and word(end - 1))


def matches(text: str | None, terms: tuple[str, ...], whole_words: bool = False, case_sensitive: bool = False) -> Iterator[tuple[int, int]]:
    """(start, end) of all matches, overlapping ones included, by end."""
    if not text:
        return
    for last, size in _automaton(terms, case_sensitive).iter(text if case_sensitive else folded(text)):
        start, end = last + 1 - size, last + 1
        if not whole_words or _bounded(text, start, end):
            yield start, end


def leftmost_longest(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that are taken from the left, the longest first."""
    out, at = [], 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out.append((start, end))
            at = end
    return out


def _checked(terms: Iterable[str]) -> tuple[str, ...]:
    found = tuple(dict.fromkeys(terms))
    if not found or "" in found:
        raise ValueError("terms are needed, and none may be empty")
    return found


def find(rows: DataFrame, terms: Iterable[str], text_col: str = "text", out: str = "matches", whole_words: bool = False, case_sensitive: bool = False) -> DataFrame:
    """``rows`` with an array of the leftmost, longest matches (term as it stands in the text, start, end); the text is left out."""
    if out.lower() in map(str.lower, rows.columns):
        raise ValueError(f"the input has a column {out} already")
    terms = _checked(terms)
    schema = T.StructType([*rows.drop(text_col).schema.fields, T.StructField(out, T.ArrayType(MATCH))])
    kind = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(text_col):
                text = value.as_py()
                found.append([{"term": text[a:b], "start": a, "end": b} for a, b in leftmost_longest(matches(text, terms, whole_words, case_sensitive))])
            yield batch.drop_columns([text_col]).append_column(out, pa.array(found, kind))

    return rows.mapInArrow(run, schema)


def scan(x: Column, terms: Iterable[str], whole_words: bool = False, case_sensitive: bool = False, redact: bool = False) -> Column:
    """Struct of text (redacted if asked for), found (any match) and terms (number of different terms that occur)."""
    terms = _checked(terms)

    def one(text: str | None) -> tuple[str | None, bool, int]:
        spans = list(matches(text, terms, whole_words, case_sensitive))
        if not spans:
            return text, False, 0
        names = {text[a:b] if case_sensitive else folded(text[a:b]) for a, b in spans}
        if redact:
            parts, at = [], 0
            for a, b in leftmost_longest(spans):
                parts += [text[at:a], REDACTED]
                at = b
            text = "".join(parts) + text[at:]
        return text, True, len(names)

    @F.pandas_udf("text string, found boolean, terms int")
    def walk(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["text", "found", "terms"])

    return walk(x)
