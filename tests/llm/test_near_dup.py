"""Near-duplicate classes against plain Python, with large nodes branched and compared in blocks."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from ragweave.llm import near_dup  # noqa: E402
from tests.llm import brute  # noqa: E402


def corpus(seed=0, bases=12, copies=25):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "😀", "A", "zZ"]
    rows = []
    for _ in range(bases):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 150))]
        for _ in range(copies):
            text = base[:]
            for _ in range(r.randint(0, 4)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append(r.choice([" ", "\n", "  \t"]).join(text))
    rows += ["", None, "  \n", "one", "One", "two words", "two  words", "x " * 5000]
    r.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def compare(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.classes(table, k=4).collect()}
    want = brute.near_classes(rows)
    assert got == want
    return want


def test_classes_equal_brute_force(spark):
    want = compare(spark, corpus())
    assert sum(i != c for i, (_, c) in want.items()) > 50


@pytest.mark.parametrize(("dense", "blocked"), [(0.5, 8), (0.5, 10**6), (2.0, 10**6)])
def test_large_nodes_lose_no_link(spark, monkeypatch, dense, blocked):
    monkeypatch.setattr(near_dup, "MOST_ROWS", 6)
    monkeypatch.setattr(near_dup, "DENSE", dense)
    monkeypatch.setattr(near_dup, "MOST_BLOCKED", blocked)
    compare(spark, corpus(1, 5, 20))


def test_special_rows(spark):
    schema = "doc_id long, text string, __gone string, nodes int"
    text = "a b c d e f g h"
    rows = [(5, text, "x", 1), (5, text, "x", 1), (2, text, "y", 2), (None, text, "z", 3), (9, None, "n", 4), (4, "", None, None)]
    table = spark.createDataFrame(rows, schema)
    got = sorted((x.doc_id or -1, x.n_shingles, x.component_id, x.kept) for x in near_dup.classes(table).collect())
    assert got == [(-1, 5, 2, False), (2, 5, 2, True), (4, 0, 4, True), (5, 5, 2, False), (5, 5, 2, False), (9, 0, 9, True)]
    left = near_dup.keep_one(table.drop("__gone"), k=4)
    assert left.columns == ["doc_id", "text", "nodes"] and sorted(x.doc_id for x in left.collect()) == [2, 4, 9]
    assert near_dup.classes(table.limit(0)).count() == 0 and near_dup.keep_one(table.limit(0).drop("__gone")).count() == 0


def test_forest_is_exact():
    r = np.random.default_rng(0)
    base = np.unique(r.integers(0, 10**6, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, len(base) - r.integers(0, 9), replace=False), r.integers(0, 10**6, r.integers(0, 6)).astype(np.uint64)])) for _ in range(40)]
    part = list(range(40))
    for i in range(40):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = part[i], part[j]
                part = [b if x == a else x for x in part]
    own = list(range(40))
    for i, j in near_dup.forest(sets):
        assert own[i] != own[j]
        a, b = own[i], own[j]
        own = [b if x == a else x for x in own]
    assert len(set(own)) == len(set(part)) and all((own[i] == own[j]) == (part[i] == part[j]) for i in range(40) for j in range(40))


def near_copies(base, n):
    """Texts of 40 words whose pairs are all similar enough, each with a word of its own at the end."""
    return [" ".join([f"{base}{i}" for i in range(40)] + [f"own{base}{j}"]) for j in range(n)]


def test_null_ids_link_and_leave_one(spark):
    a, b, c = near_copies("a", 3), near_copies("b", 3), near_copies("c", 2)
    rows = [(None, a[0]), (None, a[1]), (7, a[2]), (None, b[0]), (None, b[0]), (None, b[1]), (None, b[2]), (None, c[0]), (None, c[0]), (None, None), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_dup.classes(table)
    assert found.count() == len(rows) and found.filter("component_id = 7").count() == 3
    left = [tuple(r) for r in near_dup.keep_one(table, k=4).collect()]
    assert (7, a[2]) in left and sum(t in a for _, t in left) == sum(t in b for _, t in left) == sum(t in c for _, t in left) == 1
    assert sum(t is None for _, t in left) == 2


def test_one_id_on_two_texts_keeps_both_links(spark):
    a, b = near_copies("a", 2), near_copies("b", 3)
    rows = [(5, a[0]), (5, b[0]), (3, a[1]), (9, b[1]), (8, b[2]), (8, "a text that nothing else is like")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.classes(table).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (8, 5, False), (8, 8, True), (9, 5, False)]
    assert sorted(tuple(r) for r in near_dup.keep_one(table, k=4).collect()) == sorted([rows[1], rows[2], rows[5]])
