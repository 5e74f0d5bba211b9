"""The pipeline against a brute-force version of its stages."""

import importlib.util
import os

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from ragweave.llm import language_id, tokens  # noqa: E402
from ragweave.llm.queries import WORDS  # noqa: E402
from tests.llm import brute  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
corpus_pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else pytest.skip("no pipeline", allow_module_level=True)


def brute_force(rows, identified):
    """{doc_id: kept text} of (doc_id, text) rows."""
    kept = {i: t for i, t in rows if i in identified}
    last = {}
    for i in sorted(kept):
        last[kept[i]] = i
    kept = {i: t for t, i in last.items()}
    classes = brute.near_classes(sorted(kept.items()), k=5)
    kept = {i: t for i, t in kept.items() if classes[i][1] == i}
    ids = sorted(kept)
    return {i: raw.decode(errors="ignore") for i, (raw, _, _) in zip(ids, brute.kept_after_repeats([kept[i] for i in ids], 200))}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_force(rows, {i for i, t in rows if model.predict(t)[0] != "und"})
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, state = state, corpus_pipeline.materialize(stage(spark, state, "/root/testdata/sf0.01"), name)
        assert state.columns == docs.columns and state.count() <= before.count()
    got = {r.doc_id: r for r in state.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    library = tokens.word_encoder(WORDS).library
    ids = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == ids
    used = len({p.sequence_id for p in pieces})
    assert used <= np.ceil(sum(ids.values()) / 2048) * 1.02 + 1


def test_rejected_rows_go_and_clashing_columns_stay(spark):
    rows = [(1, "the cat and the dog were here " * 8, "en", 1), (2, "123 !!", None, 2), (3, None, "en", 3), (4, "der hund und die katze waren da " * 8, "de", 4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    left = corpus_pipeline.identified(table)
    assert left.columns == table.columns and sorted((r.doc_id, r.lang_pred) for r in left.collect()) == [(1, 1), (4, 4)]
    state = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, "")
    assert state.count() == 0


def test_odd_rows_through_all_stages(spark):
    base = [f"word{i} and the" for i in range(60)]
    a, near = " ".join(base), " ".join([*base[:-1], "other end"])
    rows = [(1, a, "en", 7), (1, a, "en", 7), (None, a, None, None), (2, None, "en", 1), (3, "123 ...", "en", 1), (4, near, None, 2), (5, "", "de", 3), (6, "der hund und die katze", "de", 4)]
    state = spark.createDataFrame(rows, "doc_id long, text string, lang string, component_id int").repartition(3)
    left = {"language_id": [None, 1, 1, 4, 6], "exact_dedup": [1, 4, 6], "near_dedup": [1, 6], "suffix_array_dedup": [1, 6]}
    for name, stage in corpus_pipeline.STAGES:
        state = corpus_pipeline.materialize(stage(spark, state, ""), name)
        if name in left:
            assert state.columns == ["doc_id", "text", "lang", "component_id"]
            assert sorted((r.doc_id for r in state.collect()), key=lambda i: (i is not None, i)) == left[name]
    assert {r.doc_id for r in state.collect()} == {1, 6} and len({r.sequence_id for r in state.collect()}) == 1


def test_a_stage_may_be_built_for_several_inputs(spark):
    make = lambda word: spark.createDataFrame([(1, f"{word} of the house " * 5), (2, f"{word} of the house " * 5), (3, "another text of words")], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["exact_dedup"]
    one, other = stage(spark, make("door"), ""), stage(spark, make("window"), "")
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in other.collect()) == [2, 3]
