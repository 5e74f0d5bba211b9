"""The automaton of many terms against regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ragweave.operators import automaton, guards


def plain(text, terms, whole, case):
    """All matches by one pattern a term, looked ahead so that they may overlap."""
    out = set()
    for t in terms:
        body = rf"\b{re.escape(t)}\b" if whole else re.escape(t)
        out |= {(m.start(), m.start() + len(t)) for m in re.finditer(f"(?={body})", text, 0 if case else re.I)}
    return out


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("case", [False, True])
def test_matches_equal_patterns(whole, case):
    rng = random.Random(5)
    for _ in range(300):
        terms = tuple({"".join(rng.choices("aBé ", k=rng.randrange(1, 4))).strip() or "a" for _ in range(6)})
        text = "".join(rng.choices("abBÉé _1", k=30))
        assert set(automaton.matches(text, terms, whole, case)) == plain(text, terms, whole, case)


def test_leftmost_longest_and_odd_texts(spark):
    assert automaton.leftmost_longest([(2, 4), (0, 3), (0, 2), (3, 5), (5, 6)]) == [(0, 3), (3, 5), (5, 6)]
    assert list(automaton.matches(None, ("a",))) == [] == list(automaton.matches("", ("a",)))
    assert list(automaton.matches("İX", ("x",))) == [(1, 2)]  # a letter whose lower case is longer keeps its place
    with pytest.raises(ValueError):
        automaton.scan(F.col("t"), [])
    with pytest.raises(ValueError):
        automaton.scan(F.col("t"), [""])


def test_ten_thousand_terms_equal_few_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    terms = ["the", "and", "stupid"]
    many = terms + [f"zq{i}x" for i in range(10_000)]
    for options in ({}, {"whole_words": True}, {"case_sensitive": True}):
        few, long = (guards.ban_substrings("text", x, redact=True, **options) for x in (terms, many))
        rows = docs.select(few.text.alias("a"), long.text.alias("b"), few.valid.alias("x"), long.valid.alias("y")).collect()
        assert all(r.a == r.b and r.x == r.y for r in rows) and any(not r.x for r in rows)
    both = guards.ban_substrings("text", terms[:2] + [f"the{''}"] * 40, contains_all=True)
    want = guards.ban_substrings("text", terms[:2], contains_all=True)
    assert docs.filter(both.valid != want.valid).count() == 0
    found = automaton.find(docs, many, whole_words=True)
    assert found.columns == ["doc_id", "matches"]
    assert {m.term.lower() for r in found.collect() for m in r.matches} <= set(terms)
    with pytest.raises(ValueError):
        automaton.find(docs.withColumn("Matches", F.lit(1)), many)
