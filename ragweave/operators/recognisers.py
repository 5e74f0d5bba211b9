"""Recognisers of personal data for the scanners: patterns, evidence, and one set of spans that don't overlap.

All kinds are searched in one reading of a text. A match counts with the score of its kind, more if a check
digit or range confirms it and if a word that speaks for it stands near; one that its check refuses is no
match, so a false card number stays. Of spans that overlap, those with the greatest sum of score times length stay
(weighted interval scheduling); ties go to the spans that end first.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from ragweave.functions import entities

#: Kinds of entities and their patterns, in the order in which their placeholders are listed.
ENTITIES = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "CREDIT_CARD": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "US_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "IP_ADDRESS": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "PHONE_NUMBER": r"\+[0-9]{1,3}[ -][0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}\b",
    "IBAN_CODE": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
}
#: Characters around a match in which context counts, and what it adds.
NEAR, CONTEXT = 40, 0.3


@dataclass(frozen=True)
class Recogniser:
    """Spans of a kind, what confirms one, its score, and the words that speak for it."""

    spans: Callable[[str], Iterator[tuple[int, int]]]
    check: Callable[[str], bool]
    score: float
    words: re.Pattern


def _of(kind: str, check: Callable[[str], bool], score: float, words: str, spans: Callable[[str], Iterator[tuple[int, int]]] | None = None) -> Recogniser:
    pattern = re.compile(ENTITIES[kind], re.ASCII)
    return Recogniser(spans or (lambda text: (m.span() for m in pattern.finditer(text))), check, score, re.compile(rf"\b(?:{words})\b", re.ASCII | re.IGNORECASE))


_DOMAIN = re.compile(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
RECOGNISERS = {
    "EMAIL_ADDRESS": _of("EMAIL_ADDRESS", lambda x: True, 0.6, "e-?mail|contact|write", lambda text: entities.mail_spans(text, _DOMAIN)),
    "CREDIT_CARD": _of("CREDIT_CARD", lambda x: entities.luhn(re.sub("[ -]", "", x)), 0.7, "card|credit|debit|visa|mastercard"),
    "US_SSN": _of("US_SSN", entities.social_security, 0.5, "ssn|social|security"),
    "IP_ADDRESS": _of("IP_ADDRESS", entities.octets, 0.6, "ip|address|host|server"),
    "PHONE_NUMBER": _of("PHONE_NUMBER", lambda x: True, 0.5, "phone|tel|call|mobile|fax"),
    "IBAN_CODE": _of("IBAN_CODE", lambda x: entities.mod97(x.replace(" ", "")) == 1, 0.8, "iban|account|bank"),
}


def found(text: str, kinds: Iterable[str], threshold: float = 0.0) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the confirmed matches with a score of ``threshold``, overlapping ones included."""
    out = []
    for kind in kinds:
        known = RECOGNISERS[kind]
        for start, end in known.spans(text):
            if known.check(text[start:end]):
                beside = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"
                score = known.score + CONTEXT * (known.words.search(beside) is not None)
                if score >= threshold:
                    out.append((start, end, kind, score))
    return out


def settled(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The spans that don't overlap and weigh most together, by start."""
    if len(spans) < 2:
        return spans
    order = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in order]
    best, take = [0.0], []
    for i, (start, end, _, score) in enumerate(order):
        before = bisect.bisect_right(ends, start, 0, i)
        weight = best[before] + score * (end - start)
        take.append((weight > best[i] + 1e-12, before))
        best.append(max(weight, best[i]))
    out, i = [], len(order)
    while i:
        taken, before = take[i - 1]
        if taken:
            out.append(order[i - 1])
        i = before if taken else i - 1
    return out[::-1]


def hidden(text: str | None, kinds: Iterable[str], threshold: float = 0.0) -> tuple[str | None, dict[str, str]]:
    """``text`` with placeholders for its findings, numbered by kind and value, and what they stand for.

    A placeholder that the text has by itself isn't given out, so putting the values back gives the text.
    """
    if not text:
        return text, {}
    vault: dict[str, str] = {}
    known: dict[tuple[str, str], str] = {}
    count: dict[str, int] = {}
    parts, at = [], 0
    for start, end, kind, _ in settled(found(text, kinds, threshold)):
        value = text[start:end]
        name = known.get((kind, value))
        while name is None:
            count[kind] = count.get(kind, 0) + 1
            free = f"[{kind}_{count[kind]}]"
            if free not in text:
                name = known[kind, value] = free
                vault[free] = value
        parts += [text[at:start], name]
        at = end
    return "".join(parts) + text[at:], vault
