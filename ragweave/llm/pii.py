"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust a score.

Each kind has a recogniser: a linear-time search for the leftmost matches that don't overlap each other, a
validator (Luhn for cards, mod 97 for IBANs, ranges for addresses, area rules for US social security
numbers), a base score and the words whose presence within ``NEAR`` characters on either side adds
``CONTEXT`` to it. A match that its validator refuses is dropped; of kinds that are weak by themselves
only matches with a score of ``THRESHOLD`` are reported, so a bare national phone number needs a word
such as "call" beside it.

The searches give the matches of the plain patterns in ``PLAIN`` but never scan a run of characters again
from each of its places: an address is found from its ``@``, digits only from the start of their run.

Results in special cases: null text has no findings; spans of different kinds may overlap, those of one
kind don't; places are code points, the end is exclusive; numbers of any length are judged without
being turned to integers; very long texts are searched whole; rows that repeat are searched each; an
empty table gives an empty result; a table that has a column ``findings`` already is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.functions.entities import luhn, mail_spans, mod97, octets, social_security

#: Characters on either side in which context words count, what they add, and the score that is asked for.
NEAR, CONTEXT, THRESHOLD = 40, 0.3, 0.5

#: The kinds and their plain patterns, in the order in which spans with equal starts are listed.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone_local": r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
}
#: Kinds that are always reported when their validator agrees.
BASE = ("email", "ip", "card", "phone")

#: Words that speak for a kind when they stand near it.
WORDS = {
    "email": "mail|email|e-mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|credit|debit|visa|mastercard|payment",
    "phone": "phone|tel|call|mobile|fax|number",
    "iban": "iban|account|bank|transfer|konto",
    "ssn": "ssn|social|security",
    "phone_local": "phone|tel|call|mobile|fax",
}
#: What a confirmed match counts for without context.
SCORES = {"email": 0.6, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.5, "phone_local": 0.3}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OTHERS = {k: re.compile(PLAIN[k], re.ASCII) for k in ("iban", "ssn", "phone_local")}
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LAST_GROUP = re.compile(r" [A-Z0-9]+$")
_NEAR = {k: re.compile(rf"\b(?:{v})\b", re.ASCII) for k, v in WORDS.items()}
_LOWER = {c: c + 32 for c in range(65, 91)}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses, each found from its ``@``."""
    return mail_spans(text, _DOMAIN)


def _ip_valid(x: str) -> str | None:
    return x if octets(x) else None


def _card_valid(x: str) -> str | None:
    if len(x) < 14:
        return None
    digits = _NOT_DIGIT.sub("", x)
    return x if 14 <= len(digits) <= 19 and luhn(digits) else None


def _phone_valid(x: str) -> str | None:
    return x if 10 <= len(_NOT_DIGIT.sub("", x)) <= 15 else None


def _iban_valid(x: str) -> str | None:
    """The match, or the match without its last group, which may be a word that follows."""
    for part in (x, _LAST_GROUP.sub("", x)):
        number = part.replace(" ", "")
        if 15 <= len(number) <= 34 and mod97(number) == 1:
            return part
    return None


def _ssn_valid(x: str) -> str | None:
    return x if social_security(x) else None


def _always(x: str) -> str:
    return x


def _matches(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


@dataclass(frozen=True)
class Recogniser:
    """How a kind is proposed, and the part of a match that is confirmed (none: dropped)."""

    propose: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], str | None]


RECOGNISERS = {
    "email": Recogniser(emails, _always),
    "ip": Recogniser(_matches(_IP), _ip_valid),
    "card": Recogniser(_matches(_CARD), _card_valid),
    "phone": Recogniser(_matches(_PHONE), _phone_valid),
    "iban": Recogniser(_matches(_OTHERS["iban"]), _iban_valid),
    "ssn": Recogniser(_matches(_OTHERS["ssn"]), _ssn_valid),
    "phone_local": Recogniser(_matches(_OTHERS["phone_local"]), _always),
}


def near_words(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a word that speaks for ``kind`` stands within ``NEAR`` characters of the span."""
    beside = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"
    return _NEAR[kind].search(beside.translate(_LOWER)) is not None


def find(text: str | None, kinds: tuple[str, ...] = tuple(PLAIN)) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all findings, by start and then in the order of ``PLAIN``."""
    out = []
    if not text:
        return out
    for order, kind in enumerate(kinds):
        known = RECOGNISERS[kind]
        for start, end in known.propose(text):
            part = known.confirm(text[start:end])
            if part is None:
                continue
            end = start + len(part)
            score = SCORES[kind] + CONTEXT * near_words(kind, text, start, end)
            if kind in BASE or score >= THRESHOLD:
                out.append((start, order, kind, end, round(score, 2)))
    return [(kind, start, end, score) for start, _, kind, end, score in sorted(out)]


FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def findings(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = tuple(PLAIN), redact: bool = False) -> DataFrame:
    """``docs`` with an array ``findings`` of (kind, start, end, score).

    With ``redact`` the text has ``[KIND]`` in place of each run of findings that overlap, by the kind of
    the first; without, it is left out, so that texts aren't sent back.
    """
    if "findings" in map(str.lower, docs.columns):
        raise ValueError("the input has a column findings already")
    unknown = set(kinds) - set(PLAIN)
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    kept = docs if redact else docs.drop(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField("findings", T.ArrayType(FINDING, False), False)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            found, clean = [], []
            for value in batch.column(at):
                text = value.as_py()
                own = find(text, kinds)
                found.append([dict(zip(("kind", "start", "end", "score"), x)) for x in own])
                if redact:
                    clean.append(redacted(text, own))
            if redact:
                batch = batch.set_column(at, text_col, pa.array(clean, batch.schema.field(at).type))
            else:
                batch = batch.drop_columns([text_col])
            yield batch.append_column("findings", pa.array(found, arrow))

    return docs.mapInArrow(run, schema)


def redacted(text: str | None, found: list[tuple[str, int, int, float]]) -> str | None:
    """``text`` with each run of overlapping findings replaced by the kind of its first."""
    if not found:
        return text
    parts, at, i = [], 0, 0
    while i < len(found):
        kind, start, end, _ = found[i]
        while i + 1 < len(found) and found[i + 1][1] < end:
            i += 1
            end = max(end, found[i][2])
        parts += [text[at:start], f"[{kind.upper()}]"]
        at, i = end, i + 1
    return "".join(parts) + text[at:]


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of findings of each base kind, digest of the base spans, and all spans as text."""
    found = findings(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(F.array_join(F.transform(base, named), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("findings", named), ",").alias("spans"))


def report_sql() -> str:
    """DuckDB SQL for ``report`` over ``documents``."""
    order = {k: i for i, k in enumerate(PLAIN)}
    proposed = " UNION ALL ".join(f"SELECT doc_id, t, '{k}' AS kind, {order[k]} AS ord, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS parts FROM d" for k, p in PLAIN.items())
    words = " ".join(f"WHEN '{k}' THEN '\\b(?:{v})\\b'" for k, v in WORDS.items())
    scores = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORES.items())
    value = "list_reduce(list_prepend(0, list_transform(string_split(x[5:] || x[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, b: (a * CASE WHEN b < 10 THEN 10 ELSE 100 END + b) % 97)"
    iban = f"list_filter([m, regexp_replace(m, ' [A-Z0-9]+$', '')], lambda y: length(replace(y, ' ', '')) BETWEEN 15 AND 34 AND {value.replace('x[', "replace(y, ' ', '')[")} = 1)[1]"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        p AS ({proposed}),
        q AS (SELECT doc_id, t, kind, ord, ms, parts, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM p),
        s AS (SELECT doc_id, t, kind, ord, m, regexp_replace(m, '[^0-9]', '', 'g') AS digits,
                (coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM q),
        v AS (SELECT doc_id, t, kind, ord, s, CASE kind
                WHEN 'ip' THEN CASE WHEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS BIGINT), 0) > 255)) = 0 THEN m END
                WHEN 'card' THEN CASE WHEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0 THEN m END
                WHEN 'phone' THEN CASE WHEN length(digits) BETWEEN 10 AND 15 THEN m END
                WHEN 'iban' THEN {iban}
                WHEN 'ssn' THEN CASE WHEN NOT (m[:3] IN ('000', '666') OR m[1] = '9' OR m[5:6] = '00' OR m[8:] = '0000') THEN m END
                ELSE m END AS m FROM s),
        f AS (SELECT *, s + length(m) AS e FROM v WHERE m IS NOT NULL),
        w AS (SELECT *, CASE kind {scores} END + CASE WHEN regexp_matches(translate(substr(t, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR})) || ' ' || substr(t, e + 1, {NEAR}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                CASE kind {words} END) THEN {CONTEXT} ELSE 0 END AS score FROM f),
        k AS (SELECT doc_id, kind, ord, s, kind || ':' || s || ':' || e AS span FROM w WHERE ord < {len(BASE)} OR score >= {THRESHOLD}),
        g AS (SELECT doc_id, {", ".join(f"count_if(kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(span, ',' ORDER BY s, ord) FILTER (ord < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY s, ord) AS spans FROM k GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""
