"""Personal data, phrases and centroids against plain Python; hubs, compaction and repeats of the older operators."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from ragweave.llm import centroids, common, exact_dup, phrases, pii, queries, token_counts  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_base(text):
    """(kind, start, end) of the base kinds by their plain patterns."""
    out = []
    for order, kind in enumerate(pii.BASE):
        for m in re.finditer(pii.PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = 0
                for i, c in enumerate(reversed(digits)):
                    d = int(c) * (1 + i % 2)
                    total += d - 9 if d > 9 else d
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.2@-+ ()9Z5é|0", max_size=60))
def test_pii_base_spans_equal_plain_patterns(text):
    assert [x[:3] for x in pii.find(text, pii.BASE)] == plain_base(text)


def test_pii_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    spans = lambda t: [(k, t[s:e]) for k, s, e, _ in pii.find(t)]
    assert spans("IBAN DE89 3704 0044 0532 0130 00 OK") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert spans("GB82WEST12345698765432, GB83WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert spans("AT61 1904 3002 3457 3201 IN") == [("iban", "AT61 1904 3002 3457 3201")]
    assert spans("219-09-9999 000-12-3456 666-12-3456 912-12-3456 123-00-4567") == [("ssn", "219-09-9999")]
    assert spans("call 212-555-0187") == [("phone_local", "212-555-0187")] and spans("part 212-555-0187") == []
    assert spans("call " + "." * 60 + " 212-555-0187") == []
    near, far = pii.find("card 4111 1111 1111 1111")[0], pii.find("4111 1111 1111 1111")[0]
    assert near[3] > far[3] and near[0] == "card"


def test_pii_whole_long_texts_in_linear_time():
    """Runs on which the plain patterns take quadratic time."""
    for unit in ("a", "1", "1 ", "1.", "a@", "+1(", "a.b@c"):
        text = unit * (300_000 // len(unit))
        pii.find(text)
    assert pii.find("x" * 200_000 + " a@b.co")[-1][:3] == ("email", 200_001, 200_007)


def test_pii_odd_tables(spark):
    rows = [(1, "a@b.co", "x"), (1, "a@b.co", "x"), (2, None, None), (None, "", "y"), (3, "😀 1.2.3.4 and a@b.co", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(pii.report(table).select("doc_id", "n_email", "n_ip", "spans").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, 1, 0, "email:0:6"), (1, 1, 0, "email:0:6"), (2, 0, 0, ""), (None, 0, 0, ""), (3, 1, 1, "ip:2:9,email:14:20")], key=str)
    clean = pii.findings(table, redact=True)
    assert clean.columns == ["doc_id", "text", "spans", "findings"]
    assert {r.text for r in clean.collect()} == {"[EMAIL]", None, "", "😀 [IP] and [EMAIL]"}
    assert pii.report(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pii.findings(table.withColumn("Findings", F.lit(1)))


def plain_phrases(rows, least, top):
    """The contract in plain Python."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for d in range(1, 6):
                for i in range(len(words) - d + 1):
                    counts[lang, tuple(words[i : i + d])] += 1
    out = {}
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = set()
    for (lang, p), f in frequent.items():
        for d in range(2, len(p)):
            for i in range(len(p) - d + 1):
                if f >= counts[lang, p[i : i + d]]:
                    inside.add((lang, p[i : i + d]))
    for (lang, p), a in frequent.items():
        if (lang, p) in inside:
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


def test_phrases_of_all_documents(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = phrases.collocations(spark.read.parquet(f"{SF}/documents.parquet"), least=5, top=300)
    assert {tuple(r) for r in got.collect()} == plain_phrases(rows, 5, 300)


def test_phrases_of_small_lots(spark):
    """Shards of a few words, blocks of a few bytes and a filter that is nearly full change nothing."""
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(x + rng.choice(["", "", "", ".", "\t", "\n"]) for x in rng.choice(["a", "B", "ç", "dd", "e?"], n))
    rows = [(rng.choice(["en", "fr", None]), draw(rng.integers(0, 300))) for _ in range(30)]
    rows = [(None if x is None else str(x), t) for x, t in rows] + [("en", None), ("en", ""), (None, "x y " * 500)]
    table = spark.createDataFrame(rows, "lang string, text string")
    want = plain_phrases(rows, 4, 50)
    assert {tuple(r) for r in phrases.collocations(table, 4, 50).collect()} == want
    for data, offsets in [common.text_views(table.toArrow().column("text"))]:
        whole = [(w, int(r)) for words, _, row in phrases.words_of(data, offsets) for w, r in zip(words.to_pylist(), row)]
        small = [(w, int(r)) for words, _, row in phrases.words_of(data, offsets, 7) for w, r in zip(words.to_pylist(), row)]
        assert whole == small
    full = np.full(1 << 13, 255, np.uint8)
    found = lambda runs: {(r.lang, r.phrase, r.n) for r in phrases.merged(runs.filter("block is not null"), 4).collect()}
    loose = common.materialize(phrases.pair_runs(table, 4, full, full), "loose")
    tally = common.materialize(phrases.tallies(table, 1 << 16, 4), "tallies")
    for shares in (1, 3):
        tight = common.materialize(phrases.pair_runs(table, 4, *phrases.reaching(tally, 1 << 16, 4, shares)), "tight")
        assert found(loose) == found(tight)
        longer = phrases.reaching(tight, 1 << 16, 4, shares, (3, 4, 5))
    pairs = common.materialize(phrases.merged(tight.filter("block is not null"), 4).filter("d = 2"), "pairs")
    assert found(phrases.deep_runs(table, full, [full] * 3)) == found(phrases.deep_runs(table, phrases.bloom(pairs), longer, 3)) != set()
    batches = phrases.merged(phrases.deep_runs(table, full, [full] * 3), 1).toArrow().to_batches(20)
    unpack = lambda blocks: [r for b in blocks for x in b.column("block") for r in pa.ipc.open_stream(x.as_buffer()).read_all().to_pylist()]
    sums = Counter()
    for r in unpack(phrases._merged_here(iter(batches * 2), 5, 64)):
        sums[r["lang"], r["phrase"]] += r["n"]
    whole = unpack(phrases._merged_here(iter(batches * 2), 5))
    assert sums == {(r["lang"], r["phrase"]): r["n"] for r in whole} and len(whole) == len(sums)
    assert phrases.collocations(table.limit(0)).count() == 0


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [p for _, p in order[:k]]
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    for r in range(rounds + 1):
        best = [min((far(p, c), j) for j, c in enumerate(centres)) for _, p in kept]
        if r < rounds:
            for j in range(len(centres)):
                own = [p for (_, p), (_, b) in zip(kept, best) if b == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own)]
    sums = Counter()
    for d, j in best:
        sums[j] += d
    return sorted((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, best))


def test_centroids(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    odd = [(1000, [1.0] * 63), (1001, None), (1002, [None] * 64), (1003, [nan] * 64), (1004, [inf] + [0.0] * 63), (1005, [0.0] * 64), (1005, [0.0] * 64), (1006, [-0.001] * 64), (1007, []), (1008, [5000.0] * 64)]
    centred = [(2000 + i, [float(x) for x in np.float32(rng.normal(0, 0.02, 64) + (i % 20))]) for i in range(300)]
    for table in (rows, rows + odd + centred, odd, centred[:5]):
        df = spark.createDataFrame([(*r, "x") for r in table], "vec_id long, embedding array<float>, cluster string")
        assert sorted(tuple(r) for r in centroids.cluster(df).collect()) == plain_clusters(table)
    assert centroids.cluster(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="distances are exact"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>"))


def test_centroids_screening_prunes(spark):
    """On separated groups nearly all centroids fall to their bounds."""
    rng = np.random.default_rng(7)
    parts = np.floor(64 * (rng.normal(0, 0.05, (2000, 64)) + rng.integers(0, 16, 2000)[:, None] * np.linspace(-1, 1, 64))).astype(np.int64)
    centres = parts[:16]
    cluster, distance, n = centroids.nearest(parts, *centroids.compressed(parts), centres)
    full = ((parts[:, None, :] - centres[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all() and n.mean() < 6


def test_hub_of_components_is_split(spark):
    """The joins of a star's hub read both sides from plain exchanges, so Spark splits the hub."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        edges = common.materialize(spark.range(1, 40_000).selectExpr("id u", "0L v"), "star")
        both = edges.union(edges.selectExpr("v", "u"))
        low = common.materialize(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m"), "low")
        joined = common.large_star(both, low)
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        got = common.connected_components(edges, "star").groupBy("component").count().collect()
        assert [(r.component, r["count"]) for r in got] == [(0, 40_000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_compaction_counts_a_batch_that_comes_meanwhile_once(spark, tmp_path, monkeypatch):
    store, target = f"{tmp_path}/a", f"{tmp_path}/b"
    rows = lambda n: spark.createDataFrame([(1, "+", "s", "en", "v", n)], "doc_id long, op string, source string, lang string, version string, n_tokens long")
    token_counts.commit(rows(5), store, "first")
    listed, seen = token_counts._complete, []

    def complete(spark_, where, kind):
        out = listed(spark_, where, kind)
        if where == store and kind == "batch" and not seen:
            seen.append(1)
            token_counts.rollup(rows(7)).write.parquet(f"{store}/batch=second")
        return out

    monkeypatch.setattr(token_counts, "_complete", complete)
    token_counts.compact(spark, store, target)
    assert seen
    assert token_counts.commit(rows(7), target, "second") and not token_counts.commit(rows(5), target, "first")
    assert [(r.n_docs, r.n_tokens) for r in token_counts.totals(spark, target).collect()] == [(2, 12)]
    with pytest.raises(ValueError):
        token_counts.commit(rows(1), store, "a*b")


def test_exact_dup_of_rows_that_repeat(spark):
    rows = [(1, "a", "z"), (1, "a", "b"), (2, "b", None), (2, "b", "q"), (1, "b", "q"), (None, "c", "y"), (None, "c", "x"), (5, None, "n"), (6, "", "m"), *[(100 + i, "hot", str(i)) for i in range(300)], (399, "hot", "0")]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    for k in (1, 256):
        marked = exact_dup.annotate_copies(table, k=k)
        assert marked.count() == len(rows)
        sizes = {(r.keep_id, r.group_size) for r in marked.collect()}
        assert sizes == {(1, 2), (2, 3), (None, 2), (6, 2), (399, 301)}
        got = {tuple(r) for r in exact_dup.drop_copies(table, k=k).collect()}
        assert got == {(1, "a", "b"), (2, "b", "q"), (None, "c", "x"), (6, "", "m"), (399, "hot", "0")}


def test_exact_dup_settles_heavy_rows_before_any_shuffle(spark):
    """Rows that the winners settle take no part in an exchange: only broadcasts lie above them."""
    docs = common.materialize(spark.range(20_000).selectExpr("id doc_id", "'hot' text"), "hot-docs")
    plan = exact_dup.annotate_copies(docs)._jdf.queryExecution().executedPlan().toString()
    heavy = plan.split("Union")[1].split("(")[0] if "Union" in plan else plan
    assert "SortMergeJoin" not in heavy and exact_dup.annotate_copies(docs).filter("kept").count() == 1


def test_all_numbered_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)} and "pipeline" in names
    assert set(queries.QUERIES) <= names
