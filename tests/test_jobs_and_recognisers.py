"""The job machine against a replay, permissions that expire, and recognisers against exhaustive search."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from ragweave.functions import entities
from ragweave.operators import evaluate, guards, recognisers
from ragweave.storage import fresh_path
from ragweave.streaming import jobs


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def replay(log, delay_us):
    """All changes of one job, command by command."""
    job, out = None, []
    for at, number, kind, n in sorted(log):
        if job and job[0] == "deleting" and at >= job[4]:
            out.append((job[4], "purged", job[3]))
            job = None
        new = jobs.step(job, kind, n, at, delay_us)
        if new is not None and new != job:
            out.append((at, new[0], new[3]))
        job = new
    if job and job[0] == "deleting":
        out.append((job[4], "purged", job[3]))
    return out


def test_steps():
    run = lambda *kinds: [x[1] for x in replay([(i * 10, i, *k) if isinstance(k, tuple) else (i * 10, i, k, 1) for i, k in enumerate(kinds)], 25)]
    assert run("progress", "submit", ("start", 2), "progress", "progress") == ["uploaded", "processing", "processing", "ingested"]
    assert run("submit", ("start", 2), "cancel", "progress", "retry") == ["uploaded", "processing", "canceled", "uploaded"]
    assert run("submit", "fail", "cancel", "progress") == ["uploaded", "error"]
    assert run("submit", "delete", "retry", "submit", "submit") == ["uploaded", "deleting", "purged", "uploaded"]
    assert replay([(0, 0, "submit", 0), (5, 1, "fail", 0), (6, 2, "retry", 0), (7, 3, "retry", 0)], 9)[-1][2] == 3


def test_stream_of_shuffled_commands_equals_a_replay(spark, rocks):
    rng = random.Random(2)
    log = {f"j{j}": [(rng.randrange(0, 300) * 1_000_000, n, rng.choice(jobs.KINDS + ("submit", "start", "progress")), rng.randrange(1, 3)) for n in range(rng.randrange(1, 25))] for j in range(12)}
    rows = [(i, at, n, kind, k) for i, x in log.items() for at, n, kind, k in x] + [(None, 5, 1, "submit", 1), ("j0", 7, 99, "unknown", 1)]
    rng.shuffle(rows)
    source, store = fresh_path(spark, "commands"), fresh_path(spark, "jobs")
    df = spark.createDataFrame(rows, "id string, us long, number long, kind string, n long").select("id", F.timestamp_micros("us").alias("at"), "number", "kind", "n")
    df.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = jobs.transitions(stream, "10 minutes", 40)
    query = lambda: found.writeStream.outputMode("append").option("checkpointLocation", store + "-checkpoint").trigger(availableNow=True).format("parquet").start(store).awaitTermination()
    query()
    spark.createDataFrame([("end", 0, "fail", 0)], "id string, number long, kind string, n long").select("id", F.timestamp_micros(F.lit(10**10)).alias("at"), "number", "kind", "n").write.mode("append").parquet(source)
    query()
    got = {}
    for r in spark.read.schema(found.schema).parquet(store).collect():
        got.setdefault(r.id, []).append((r.at_us, r.number, r.status, r.attempt))
    want = {i: replay(x, 40_000_000) for i, x in log.items()}
    assert {i: [(at, status, attempt) for at, _, status, attempt in sorted(x)] for i, x in got.items()} == {i: x for i, x in want.items() if x}


def test_permissions_expire(spark, rocks):
    source, store = fresh_path(spark, "requests"), fresh_path(spark, "asked")
    put = lambda *users: spark.createDataFrame([(u,) for u in users], "user_id string").coalesce(1).write.mode("append").parquet(source)
    put("a", "a", "b", None)
    found = jobs.to_ask(spark.readStream.schema("user_id string").parquet(source), 4)

    def run():
        found.writeStream.outputMode("append").option("checkpointLocation", store + "-checkpoint").trigger(once=True).format("parquet").start(store).awaitTermination()
        return sorted(r.user_id for r in spark.read.schema(found.schema).parquet(store).collect())

    assert run() == ["a", "b"]
    time.sleep(5)
    put("a", "c")
    assert run() == ["a", "a", "b", "c"]


def test_settled_spans_weigh_most():
    rng = random.Random(1)
    for _ in range(200):
        spans = [(s, s + rng.randrange(1, 8), rng.choice("xyz"), rng.choice([0.3, 0.5, 0.9])) for s in (rng.randrange(0, 20) for _ in range(rng.randrange(0, 7)))]
        weight = lambda x: sum(p * (e - s) for s, e, _, p in x)
        apart = lambda x: all(a[1] <= b[0] for a, b in itertools.pairwise(sorted(x)))
        got = recognisers.settled(spans)
        assert apart(got) and weight(got) == pytest.approx(max(weight(c) for n in range(len(spans) + 1) for c in itertools.combinations(spans, n) if apart(c)))


def test_recognisers_want_evidence():
    hide = lambda t, **k: recognisers.hidden(t, recognisers.ENTITIES, **k)
    assert hide("card 4111 1111 1111 1112 and 4111 1111 1111 1111")[0] == "card 4111 1111 1111 1112 and [CREDIT_CARD_1]"
    assert hide("1.2.3.4 1.2.3.999 000-12-3456 219-09-9999")[0] == "[IP_ADDRESS_1] 1.2.3.999 000-12-3456 [US_SSN_1]"
    assert hide("DE89370400440532013000 DE88370400440532013000")[0] == "[IBAN_CODE_1] DE88370400440532013000"
    assert hide("me@1.2.3.4.example.org")[0] == "[EMAIL_ADDRESS_1]"  # the longer span, not the address inside it
    assert hide("219-09-9999", threshold=0.6)[0] == "219-09-9999" and hide("ssn 219-09-9999", threshold=0.6)[0] == "ssn [US_SSN_1]"
    own = "[EMAIL_ADDRESS_1] a@b.co a@b.co c@d.org"
    text, vault = hide(own)
    assert text == "[EMAIL_ADDRESS_1] [EMAIL_ADDRESS_2] [EMAIL_ADDRESS_2] [EMAIL_ADDRESS_3]" and vault == {"[EMAIL_ADDRESS_2]": "a@b.co", "[EMAIL_ADDRESS_3]": "c@d.org"}
    assert hide(None) == (None, {}) and hide("") == ("", {}) and entities.luhn("79927398713") and not entities.luhn("79927398710")


def test_anonymize_gives_texts_back(spark):
    texts = [None, "", "[EMAIL_ADDRESS_1] a@b.co", "nothing here", "x@y.org +1 212 555 0100 x@y.org", "é" * 5 + " 10.0.0.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = df.select("t", guards.anonymize("t").alias("h")).select("t", F.col("h.text").alias("clean"), guards.deanonymize("h.text", "h.vault").alias("back")).collect()
    assert all(r.t == r.back for r in rows) and sum(r.t != r.clean for r in rows) == 3
    with pytest.raises(ValueError):
        guards.anonymize("t", ["NOTHING"])


def test_ngram_sums_read_the_pairs_once(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "a", "c"]), (2, [], ["x"]), (3, None, None), (4, ["q"], ["q"])], "pair_id int, hypothesis array<string>, reference array<string>")
    got = {(r.pair_id, r.n): (r.matched, r.total, r.asked) for r in evaluate.ngram_sums(df, [1, 2]).collect()}
    assert got == {(1, 1): (2, 3, 3), (1, 2): (0, 2, 2), (2, 1): (0, 0, 1), (2, 2): (0, 0, 0), (3, 1): (0, 0, 0), (3, 2): (0, 0, 0), (4, 1): (1, 1, 1), (4, 2): (0, 0, 0)}
    path = fresh_path(spark, "pairs")
    df.write.parquet(path)
    plan = evaluate.rouge_n(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan
    scores = {r.pair_id: (r.rouge1, r.rouge2, r.rougeL) for r in evaluate.scored(df.filter("pair_id <> 3"), ["rouge1", "rouge2", "rougeL"]).collect()}
    assert scores[4] == (1.0, 0.0, 1.0) and scores[1][0] == pytest.approx(4 / 6)
    assert evaluate.bleu(df).first().bleu == 0 and evaluate.bleu(df.limit(0)).first().bleu == 0
