"""Text scanners: each gives the sanitised text, whether the text is valid, and a risk score.

All are Column expressions; ``scan`` runs several over one pass of the table. Scanners that need a
trained model take a scoring column instead (``by_score``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.operators import automaton, recognisers
from ragweave.operators.recognisers import ENTITIES

REDACTED = "[REDACTED]"

#: Shapes of credentials.
SECRETS = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"\b[Tt]oken\s*=\s*\x22[0-9a-f]{40}\x22",
    r"[Bb]earer\s+[A-Za-z0-9._~+/-]{20,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)

REFUSALS = ("I'm sorry", "I am sorry", "I cannot", "I can't", "I am unable", "As an AI")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass
class Finding:
    """Result columns of a scanner."""

    text: Column
    valid: Column
    score: Column


def _alternatives(terms: Iterable[str], whole_words: bool) -> str:
    body = "|".join(re.escape(t) for t in terms)
    return rf"\b(?:{body})\b" if whole_words else f"(?:{body})"


#: Terms up to which each is a pattern of its own; more go through one automaton.
MOST_PATTERNS = 32


def ban_substrings(x: Column | str, terms: list[str], whole_words: bool = False, case_sensitive: bool = False, redact: bool = False, contains_all: bool = False) -> Finding:
    """Valid unless a term occurs (or all do); redaction puts a mark for each. A long list costs one pass, as a short one does."""
    if not terms:
        raise ValueError("no terms given")
    x, flag = _c(x), "" if case_sensitive else "(?i)"
    if len(terms) > MOST_PATTERNS:
        seen = automaton.scan(x, terms, whole_words, case_sensitive, redact)
        wanted = len({t if case_sensitive else automaton.folded(t) for t in terms})
        found = seen["terms"] >= wanted if contains_all else seen["found"]
        return Finding(F.when(found, seen["text"]).otherwise(x) if redact else x, ~found, found.cast("double"))
    each = [x.rlike(flag + _alternatives([t], whole_words)) for t in terms]
    found = each[0]
    for e in each[1:]:
        found = found & e if contains_all else found | e
    clean = F.when(found, F.regexp_replace(x, flag + _alternatives(sorted(terms, key=len, reverse=True), whole_words), REDACTED)).otherwise(x) if redact else x
    return Finding(clean, ~found, found.cast("double"))


def match_regex(x: Column | str, patterns: list[str], blocked: bool = True, redact: bool = False) -> Finding:
    """Blocked: valid unless a pattern occurs; else valid only if one does. The first that matches redacts."""
    if not patterns:
        raise ValueError("no patterns given")
    x = _c(x)
    found, clean = F.lit(False), x
    for p in reversed(patterns):
        if redact:
            clean = F.when(x.rlike(p), F.regexp_replace(x, p, REDACTED)).otherwise(clean)
        found = found | x.rlike(p)
    return Finding(clean if blocked else x, ~found if blocked else found, (found if blocked else ~found).cast("double"))


def secrets(x: Column | str, mode: str = "all", patterns: Iterable[str] = SECRETS) -> Finding:
    """Credentials hidden wholly, partly (two characters at both ends stay) or by a hash of the match."""
    x, joined = _c(x), "|".join(f"(?:{p})" for p in patterns)
    hide: dict[str, Callable[[Column], Column]] = {
        "all": lambda h: F.lit("******"),
        "partial": lambda h: F.concat(F.substring(h, 1, 2), F.lit(".."), F.right(h, F.lit(2))),
        "hash": lambda h: F.md5(h.cast("binary")),
    }
    if mode not in hide:
        raise ValueError(f"unknown mode {mode}")
    found = x.rlike(joined)
    return Finding(F.when(found, _matches_replaced(x, joined, hide[mode])).otherwise(x), ~found, found.cast("double"))


def _matches_replaced(x: Column, pattern: str, put: Callable[[Column], Column]) -> Column:
    """``x`` with ``put(match)`` for each match: what stands between matches and the replaced ones, joined once."""
    hits = F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))
    return F.array_join(F.zip_with(F.split(x, pattern), F.transform(hits, put), lambda part, h: F.concat(part, F.coalesce(h, F.lit("")))), "")


def invisible(x: Column | str) -> Finding:
    """Format, private-use and unassigned characters go."""
    x = _c(x)
    clean = F.regexp_replace(x, r"[\p{Cf}\p{Co}\p{Cn}]", "")
    return Finding(clean, clean == x, (clean != x).cast("double"))


def token_limit(x: Column | str, most: int, count: Column | None = None) -> Finding:
    """By white-space tokens, or by a column of counts; the text is cut to the limit only for white space."""
    x = _c(x)
    tokens = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    n = F.size(tokens) if count is None else count
    clean = F.when(n > most, F.array_join(F.slice(tokens, 1, most), " ")).otherwise(x) if count is None else x
    return Finding(clean, n <= most, F.when(n <= most, 0.0).otherwise(1.0))


def reading_time(x: Column | str, minutes: float = 0.5, words_per_minute: int = 200, truncate: bool = False) -> Finding:
    x = _c(x)
    tokens = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    valid = F.size(tokens) / words_per_minute <= minutes
    clean = F.when(valid, x).otherwise(F.array_join(F.slice(tokens, 1, int(minutes * words_per_minute)), " ")) if truncate else x
    return Finding(clean, valid, F.when(valid, 0.0).otherwise(1.0))


def valid_json(x: Column | str, required: int = 0, elements: str = "MAP<STRING, STRING>") -> Finding:
    """Parses as a JSON object with at least ``required`` members."""
    x = _c(x)
    parsed = F.from_json(x, elements)
    valid = F.coalesce(F.get_json_object(x, "$").isNotNull() & (F.size(parsed) >= required), F.lit(False))
    return Finding(x, valid, F.when(valid, 0.0).otherwise(1.0))


def refusal(x: Column | str, phrases: Iterable[str] = REFUSALS) -> Finding:
    return ban_substrings(x, list(phrases))


def urls(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"(https?://[^\s\x22'<>)]+)"), F.lit(1))


def by_score(x: Column | str, score: Column, threshold: float, invert: bool = False) -> Finding:
    """A model's score against a threshold: topics, toxicity, bias, injection, relevance, sentiment."""
    bad = score < threshold if invert else score > threshold
    return Finding(_c(x), ~bad, score)


def anonymize(x: Column | str, kinds: Iterable[str] = tuple(ENTITIES), threshold: float = 0.0) -> Column:
    """Struct of text and vault: findings of all kinds, in one reading, numbered by kind in order of appearance.

    A text's equal values share a placeholder; the vault maps placeholders back. Null text stays null.
    """
    kinds = tuple(kinds)
    if lost := set(kinds) - set(ENTITIES):
        raise ValueError(f"unknown kinds {sorted(lost)}")

    @F.pandas_udf("text string, vault map<string,string>")
    def hide(texts: pd.Series) -> pd.DataFrame:
        done = [recognisers.hidden(t, kinds, threshold) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in done], "vault": [v for _, v in done]})

    return hide(_c(x))


#: Placeholders that ``anonymize`` puts.
PLACEHOLDER = r"\[[A-Z_]+_[0-9]+\]"


def deanonymize(x: Column | str, vault: Column | str) -> Column:
    """``x`` with the vault's values for its placeholders; others stay."""
    return _matches_replaced(_c(x), PLACEHOLDER, lambda h: F.coalesce(_c(vault)[h], h))


def scan(df: DataFrame, text_col: str, scanners: dict[str, Callable[[Column], Finding]]) -> DataFrame:
    """``df`` with text sanitised by all scanners in turn, ``valid`` and ``rejected_by`` (the first invalid)."""
    if not scanners:
        return df.withColumns({"valid": F.lit(True), "rejected_by": F.lit(None).cast("string")})
    out, flags = df, []
    for name, scanner in scanners.items():
        found = scanner(F.col(text_col))
        out = out.withColumns({f"__{name}": found.valid, text_col: found.text})
        flags.append(F.when(~F.col(f"__{name}"), F.lit(name)))
    out = out.withColumn("rejected_by", F.coalesce(*flags))
    return out.withColumn("valid", F.col("rejected_by").isNull()).drop(*[f"__{n}" for n in scanners])
