"""Packing: pieces against the library, sequences against their rules and the lower bound."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from ragweave.llm import packing, tokens  # noqa: E402
from ragweave.llm.queries import WORDS  # noqa: E402


def packed(spark, texts, capacity, shard=10**6):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.asDict() for r in packing.pack(packing.cut_pieces(table, WORDS, capacity), capacity, shard).collect()]


def check(rows, texts, capacity):
    library = tokens.word_encoder(WORDS).library
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc.pop(i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == r["piece"] * capacity and len(part) == r["length"] == min(capacity, len(ids) - r["start"])
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), -(-sum(r["length"] for r in rows) // capacity)


@pytest.mark.parametrize("shard", [10**6, 20])
def test_sequences_keep_the_rules_and_are_few(spark, shard):
    r = random.Random(0)
    texts = ["word " * r.randint(0, 90) for _ in range(150)] + ["", None, "naïve 漢字 <|endoftext|>", "a b " * 64, "same", "same"]
    used, least = check(packed(spark, texts, 64, shard), texts, 64)
    assert used <= least * (1.03 if shard > 1000 else 1.12) + 1


def test_special_tables(spark):
    assert packed(spark, [], 64) == []
    assert check(packed(spark, [None], 64), [None], 64) == (1, 1)
    with pytest.raises(ValueError):
        packed(spark, ["a"], 0)


def test_crossover_and_evolution_keep_every_item():
    r = random.Random(1)
    lengths = Counter(r.randint(1, 100) for _ in range(400))
    items = sorted(lengths.elements(), reverse=True)
    a, b = packing.best_fit(items, [], 100), packing.best_fit(items[::-1], [], 100)
    child = packing.crossover(a, b, lengths, 100, r)
    assert Counter(x for s in child for x in s) == lengths and max(map(sum, child)) <= 100
    best = packing.evolve(lengths, 100, 3, [b]).bins
    assert Counter(x for s in best for x in s) == lengths and packing.fitness(best, 100) >= packing.fitness(b, 100)
    assert packing.unpack_solution(packing.pack_solution(best)) == best


def test_crossover_injects_whole_bins_without_repeats():
    a, b = [[60, 40], [50, 50], [30, 30], [20]], [[50, 50], [60, 40], [30, 20], [30]]
    lengths, always = Counter([60, 40, 50, 50, 30, 30, 20]), random.Random()
    always.random = lambda: 0.0
    child = packing.crossover(a, b, lengths, 100, always)
    assert [50, 50] in child or [60, 40] in child
    assert Counter(x for s in child for x in s) == lengths and len(child) == 3


@pytest.mark.parametrize(("size", "bound"), [("sf0.01", 315), ("sf0.1", 3202)])
def test_children_reach_the_bound(size, bound):
    import pyarrow.parquet as pq

    column = pq.read_table(f"/root/testdata/{size}/documents.parquet", columns=["text"])["text"].combine_chunks()
    _, ends = tokens.word_encoder(WORDS).encode_column(column)
    lengths = Counter(x for n in (np.diff(ends) + 1).tolist() if (x := n % 2048 if n > 2048 else n) % 2048)
    assert -(-sum(x * n for x, n in lengths.items()) // 2048) == bound
    migrants, children = [], 0
    for epoch in range(packing.EPOCHS):
        found = packing.evolve(lengths, 2048, epoch, migrants)
        migrants, children = [found.bins], children + found.children
    assert found.is_child and children > 0 and len(found.bins) == bound
    assert Counter(x for s in found.bins for x in s) == lengths


def test_a_very_long_text_is_encoded_in_blocks(monkeypatch):
    import pyarrow as pa

    coder = tokens.word_encoder(WORDS)
    text = "Some words, and é more. " * 300 + "漢 字"
    whole, _ = coder.encode_column(pa.array([text]))
    monkeypatch.setattr(tokens, "BLOCK", 100)
    monkeypatch.setattr(tokens.blocks, "__defaults__", (100,))
    ids, ends = coder.encode_column(pa.array([text]))
    assert ids.tolist() == whole.tolist() and ends.tolist() == [0, len(ids)]


@pytest.mark.parametrize("text", ["漢字" * 900, "1,22,333\n" * 300, "word\n" * 400, "QUJD" * 700, "Some words here. " * 40 + "漢" * 2000, "two words " * 90 + "12;" * 900])
def test_a_very_long_text_without_seams_is_encoded_whole(monkeypatch, text):
    import pyarrow as pa

    coder = tokens.word_encoder(WORDS)
    monkeypatch.setattr(tokens, "BLOCK", 100)
    monkeypatch.setattr(tokens.blocks, "__defaults__", (100,))
    ids, ends = coder.encode_column(pa.array([text]))
    assert ids.tolist() == coder.library.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]
