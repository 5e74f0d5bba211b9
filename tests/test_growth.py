"""Steps whose shuffles, rounds or memory once grew faster than their input."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ragweave.operators import chunks, evaluate, linear, models, search
from ragweave.plans import load
from ragweave.sources import web
from ragweave.streaming import jobs

QUERIES = load().QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_are_counted_within_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = lambda: [f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 30))]
    rows = [(i, words(), words()) for i in range(60)] + [(60, None, ["w1"]), (61, ["w1"], None)]
    df = spark.createDataFrame(rows, "pair_id long, hypothesis array<string>, reference array<string>").coalesce(1)
    want = {}
    for i, h, r in rows:
        for n in (1, 2, 4):
            a, b = (Counter(zip(*((x or [])[k:] for k in range(n)))) for x in (h, r))
            want[i, n] = (sum((a & b).values()), sum(a.values()), sum(b.values()))
    for most in (1 << 20, 40):
        monkeypatch.setattr(evaluate, "TOKENS", most)
        sums = evaluate.ngram_sums(df, [1, 2, 4])
        assert {(r.pair_id, r.n): (r.matched, r.total, r.asked) for r in sums.collect()} == want
    assert "Generate" not in plan_of(sums) and "Aggregate" not in plan_of(sums)


def test_13a_tokens_keep_to_the_rules(spark):
    texts = ["a .b, c. d", "1.5 , 2-3 -4", " x..y ,, .", "[a]&b!c  d\n.e"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for pattern, put in evaluate.RULES_13A:
        t = F.regexp_replace(t, pattern, put)
    plain = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    assert all(r.a == r.b for r in df.select(evaluate.tokens_13a("t").alias("a"), plain.alias("b")).collect())


def test_only_texts_are_joined_for_trigrams(spark, sf):
    plan = plan_of(QUERIES["trigram_overlap_neighbours"](spark, sf))
    assert "split(" in plan and "split(" not in plan[plan.index("Join") :]


def test_cells_shuffle_no_vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = e.filter("vec_id % 9 = 0").selectExpr("vec_id query_id", "embedding query_vec")
    centres = search.fit_cells(e, 8)
    found = search.knn_cells(e, asked, centres, 4, 3)
    assert "Join" not in plan_of(found)
    cell = lambda df, c, n: search.assign_cells(df, centres, n, c)
    rows = {r.vec_id: (np.array(r.embedding, float), r.cells[0]) for r in cell(e, "embedding", 1).collect()}
    want = set()
    for r in cell(asked, "query_vec", 3).collect():
        q = np.array(r.query_vec, float)
        d = sorted((1 - x @ q / (np.linalg.norm(x) * np.linalg.norm(q)), i) for i, (x, c) in rows.items() if c in r.cells)
        want |= {(r.query_id, i, rank + 1) for rank, (_, i) in enumerate(d[:4])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == want
    assert search.knn_cells(e, asked, [], 4, 3).count() == 4 * asked.count()


def test_semantic_parts_are_found_in_one_row(spark, monkeypatch):
    monkeypatch.setattr(chunks, "semantic_groups", None)
    text = "A b c. A b c! A b d? Q r s. Q r t. Z. Q r s"
    rows = chunks.semantic(spark.createDataFrame([(1, text), (2, None), (3, "one"), (4, "")], "doc_id int, text string"), lambda df, c: models.embed(df, c, 16), percentile=0.5).collect()
    own = [r.chunk_text for r in sorted(rows, key=lambda r: r.part) if r.doc_id == 1]
    assert " ".join(own) == text and len(own) > 1 and [r.chunk_text for r in rows if r.doc_id != 1] == ["one"]


def test_words_are_hashed_alike_in_a_batch():
    texts = ["a b c a", "", None, "Ünï x x x y", "q"]
    assert (models.word_vectors(texts, 16) == np.stack([models.word_vector(t, 16) for t in texts])).all()


def test_late_chunks_join_no_positions(spark, sf):
    assert plan_of(QUERIES["late_chunking"](spark, sf)).count("Join") == 1


def test_rounds_read_packed_places_that_count(spark):
    rng = np.random.default_rng(2)
    rows = [(sorted(map(int, rng.choice(linear.DIMS, rng.integers(0, 9), replace=False))), int(rng.integers(0, 3))) for _ in range(50)]
    df = spark.createDataFrame(rows, "features array<int>, y int")
    used = rng.random(linear.DIMS) < 0.6
    weights = rng.normal(0, 0.1, (linear.DIMS + 1, 3)).astype(np.float32)
    kept = np.append(used, True)
    got, n = linear._gradient(linear._packed(df, used), weights[kept], np.ones(used.sum(), bool))
    want, m = linear._gradient(df, weights, used)
    assert n == m == 50 and np.allclose(got, want[kept]) and not want[~kept].any()


def test_python_workers_get_small_batches(spark, sf):
    name, pages = "spark.sql.execution.arrow.maxBytesPerBatch", spark.read.parquet(f"{sf}/pages.parquet")
    before = spark.conf.get(name)
    try:
        for run in (lambda: web.main_text(pages), lambda: linear.predict(pages.select("page_id", "html"), linear.Model(["x"], np.zeros((linear.DIMS + 1, 1)), np.zeros(linear.DIMS, bool)), "html")):
            spark.conf.unset(name)
            run()
            assert spark.conf.get(name) == "4m"
    finally:
        spark.conf.set(name, before)


def test_a_jobs_commands_go_to_the_store_at_once():
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    machine = jobs.JobMachine(1)
    machine.handle = machine.wake = machine.pending = Store()
    row = type("R", (), {"at_us": 5000, "number": 1, "kind": "start", "n": 1})
    list(machine.handleInputRows(("a",), iter([row] * 50), None))
    assert calls.count("appendList") == 1 and "appendValue" not in calls
