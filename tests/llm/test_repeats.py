"""Repeated byte strings against a plain count of all windows."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from ragweave.llm import repeats  # noqa: E402
from tests.llm import brute  # noqa: E402


def corpus(seed=0):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [line(n) for n in (19, 20, 21, 40, 90, 300)]
    texts = ["", None, "short", "ab" * 200, "x" * 500, "x" * 21, "x" * 20]
    for _ in range(120):
        parts = [line(r.randint(0, 40))]
        for _ in range(r.randint(0, 4)):
            part = r.choice(shared)
            if r.random() < 0.4:
                at = r.randrange(len(part))
                part = part[:at] + r.choice("XYZ") + part[at + 1 :]
            parts += [part, line(r.randint(0, 30))]
        texts.append("".join(parts))
    return texts + texts[20:25]


def check(spark, texts, span, k):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in repeats.report(table, span, k).collect()}
    for i, (kept, removed, runs) in enumerate(brute.kept_after_repeats(texts, span)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len((texts[i] or "").encode()), removed, runs)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("span,k", [(20, 6), (33, 30)])
def test_spans_equal_brute_force(spark, span, k):
    check(spark, corpus(), span, k)


def test_counting_gives_the_same_spans(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", 1)
    check(spark, corpus(1), 20, 6)


def test_columns_against_windows():
    r = random.Random(5)
    for _ in range(30):
        n, span = r.randint(2, 40), 8
        left, right = [r.randint(2, 5) for _ in range(n)], [r.randint(0, 2) for _ in range(n)]
        texts = [np.array([r.choice([97, 98]) for _ in range(a + span - b)], np.uint8) for a, b in zip(left, right)]
        group = np.array([r.randint(0, 3) for _ in range(n)])
        found = repeats.repeated_windows(texts, group, np.array(left), np.array(right), span)
        windows = [(group[i], left[i] - j, texts[i][j : j + span].tobytes()) for i in range(n) for j in range(left[i] - right[i] + 1)]
        for i in range(n):
            want = [windows.count((group[i], left[i] - j, texts[i][j : j + span].tobytes())) > 1 for j in range(left[i] - right[i] + 1)]
            assert found[i].tolist() == want


def test_long_rows_are_cut_in_pieces(monkeypatch):
    import pyarrow as pa

    from ragweave.llm.common import text_views

    data, offsets = text_views(pa.array(["".join(t or "" for t in corpus(2))]))
    monkeypatch.setattr(repeats, "BLOCK", 500)
    pieces = list(repeats._pieces(offsets, 0, 1, 20))
    assert len(pieces) > 3
    whole = repeats.anchors(data, offsets, 20, 6)
    starts = lambda found, base: {(int(a) + base, s) for _, a, s in ((0, x, y) for x, f, t in zip(found[2], found[3], found[4]) for y in range(int(f) + 0, int(t) + 1) for x in [x])}
    want = {(a, s) for a, s in starts(whole, 0)}
    got = set()
    for begin, end in pieces:
        found = repeats.anchors(data[begin:end], np.array([0, end - begin]), 20, 6)
        got |= {(a, s + begin) for a, s in starts(found, begin)}
    assert got == want


def test_special_rows_and_cutting(spark):
    line = "one two three four five six seven"
    rows = [(1, line + "é", "a", 3), (1, line + "é", "a", 3), (None, "x" + line, "b", 4), (2, None, "c", 5), (3, "é" * 40, "d", 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, cut_id string, n_chars long")
    left = repeats.cut_repeats(table, 20, 6)
    assert left.columns == table.columns
    got = sorted((x.doc_id or 0, x.text, x.n_chars) for x in left.collect() if x.text is not None)
    assert got == [(0, "x", 1), (1, "é", 1), (1, "é", 1), (3, "", 0)]
    only = spark.createDataFrame(rows[:2], table.schema)
    assert {x.text for x in repeats.cut_repeats(only, 20, 6).collect()} == {line + "é"}
    assert repeats.report(table.limit(0)).count() == 0
