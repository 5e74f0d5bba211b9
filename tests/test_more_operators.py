"""Operators with hooks, nested values, tables that change in part, and streams with late rows."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from ragweave.functions import nested
from ragweave.functions import text as X
from ragweave.operators import chunks, evaluate, filters, models, rerank, segments, stats, tables
from ragweave.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("out")).first()["out"]


def test_names_and_settings(spark):
    for name, space in (("http://a.b/c", "url"), ("é", "dns"), ("", "dns")):
        assert one(spark, X.name_uuid(F.lit(name), space)) == str(uuid.uuid5({"url": uuid.NAMESPACE_URL, "dns": uuid.NAMESPACE_DNS}[space], name))
    said = {t: one(spark, X.setting(F.lit(t))) for t in ("3.5", "'12'", '"TRUE"', "false", " a b ", "-7")}
    assert [tuple(r) for r in said.values()] == [(3.5, None, None), (12.0, None, None), (None, True, None), (None, False, None), (None, None, "a b"), (-7.0, None, None)]


def test_nested_values(spark):
    rows = spark.createDataFrame([({"x": "a"}, [(1, None), (2, "b")], {"id": "1", "x": "a"})], "m map<string,string>, l array<struct<id:int,v:string>>, k map<string,string>").select(F.struct("m", "l").alias("row"), "k")
    kind = rows.schema["row"].dataType
    assert rows.select(nested.flatten_text(F.col("row"), kind).alias("t")).first().t == "a 1 2 b"
    assert nested.drop_key(rows, "k", "id").first().k == {"x": "a"}
    bare = nested.drop_key(rows, "row", "id").first().row
    assert bare.m == {"x": "a"} and [tuple(x) for x in bare.l] == [(None,), ("b",)]
    a, b = F.create_map(F.lit("k"), F.lit(1), F.lit("l"), F.lit(2)), F.create_map(F.lit("k"), F.lit(9))
    assert one(spark, nested.merge_maps(a, b)) == {"l": 2, "k": 9}


def test_header_like(spark):
    said = [one(spark, filters.header_like(F.lit(h), F.lit(w))) for h, w in (("Intro", "intro:"), ("Intr", "Intro"), ("Out", "Intro"), (None, "x"))]
    assert said == [True, True, False, False]


def test_scorers_splitters_compressors_and_metrics_by_name(spark):
    rows = spark.createDataFrame([(i, "a b", "b c " * i) for i in range(5)] + [(9, None, None)], "id int, query string, text string")
    got = {r.id: r.score for r in rerank.scored(rows, lambda q, t: [float(len(x)) for x in t], batch=2).collect()}
    assert got == {0: 0.0, 1: 4.0, 2: 8.0, 3: 12.0, 4: 16.0, 9: 0.0}
    with pytest.raises(Exception, match="one number"):
        rerank.scored(rows, lambda q, t: [1.0, 2.0, 3.0], batch=2).collect()
    chunks.register_splitter("lines", lambda df, size, overlap, **_: df.select("id", F.posexplode(F.split("text", " ")).alias("chunk", "chunk_text")))
    assert chunks.split(rows.filter("id = 2"), "lines", 1, 0).count() == 5
    segments.register_compressor("upper", lambda df, text_col: df.withColumn(text_col, F.upper(text_col)))
    assert segments.compress(rows.filter("id = 1"), [{"name": "upper"}]).first().text == "B C "
    evaluate.register_metric("same", lambda pairs: pairs.select("pair_id", (F.col("hypothesis") == F.col("reference")).alias("same")))
    pairs = spark.createDataFrame([(1, ["a", "b"], ["a", "b"]), (2, ["a"], ["b"])], "pair_id int, hypothesis array<string>, reference array<string>")
    assert {r.pair_id: (r.same, r.rouge1) for r in evaluate.scored(pairs, ["same", "rouge1"]).collect()} == {1: (True, 1.0), 2: (False, 0.0)}
    for wrong in (lambda: chunks.split(rows, "no", 1, 0), lambda: segments.compress(rows, [{"name": "no"}]), lambda: evaluate.scored(pairs, ["no"])):
        with pytest.raises(ValueError):
            wrong()


def test_connectors_and_reports(spark, tmp_path):
    models.register_connector("lengths", models.batched(lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2))
    rows = spark.createDataFrame([(i, "x" * i) for i in range(6)], "i int, text string")
    assert {r.i: list(r.embedding) for r in models.embedded(rows, "lengths", dims=2).collect()} == {i: [float(i), 1.0] for i in range(1, 6)}
    with pytest.raises(ValueError):
        models.embedded(rows, "no")
    with pytest.raises(Exception, match="asked for"):
        models.embedded(rows, "lengths", dims=3).collect()
    (tmp_path / "t.csv").write_text("10,5,0.5,3.0,,200\n20,0,0.7,0.7,late,500\n")
    test = stats.read_load_test(spark, f"file://{tmp_path}/t.csv")
    assert [tuple(r) for r in test.collect()] == [(10, 5, 0.5, 3.0, None, 200), (20, 0, 0.7, 0.7, "late", 500)]
    stats.write_csv(stats.load_test(test, 4), f"file://{tmp_path}/report")
    assert float(spark.read.option("header", "true").csv(f"file://{tmp_path}/report").first().tokens_per_second) == 8.0


def test_rouge_lsum_and_bootstrap(spark):
    pairs = spark.createDataFrame([(1, "w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5"), (2, "", "a"), (3, "same line\nother", "same line\nother")], "pair_id int, hypothesis string, reference string")
    got = {r.pair_id: r.rouge_lsum for r in evaluate.rouge_lsum(pairs).collect()}
    assert got == {1: pytest.approx(2 * 4 / 15), 2: 0.0, 3: 1.0}
    rows = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"))
    (r,) = evaluate.bootstrap(rows, ["x"], "id").collect()
    (again,) = evaluate.bootstrap(rows.repartition(7), ["x"], "id").collect()
    assert r.low < 4.5 < r.high and abs(r.mid - 4.5) < 0.2 and r.high - r.low < 1
    assert (r.low, r.mid, r.high) == pytest.approx((again.low, again.mid, again.high))


def test_chunks_keep_columns_and_refuse_clashes(spark):
    rows = spark.createDataFrame([(1, "a b c", "s", 5), (2, None, "t", None)], "doc_id long, text string, source string, Chunk int")
    assert chunks.with_metadata(rows, 4, 0).columns == ["doc_id", "source", "chunk", "start_index", "chunk_text"]
    assert {tuple(r) for r in chunks.with_metadata(rows, 4, 0).collect()} == {(1, "s", 0, 0, "a b"), (1, "s", 1, 4, "c")}
    with pytest.raises(ValueError):
        chunks.recursive(rows, 4, 0, keep=["Chunk"])
    with pytest.raises(ValueError):
        chunks.late_chunks(rows, lambda d: d, 8, 0, 1, macro=4)


def test_speech_parts_against_a_loop(spark):
    import random
    import re

    r = random.Random(5)
    texts = ["".join(r.choice(["word ", "it", ". ", ", ", "! ", "\n", "long" * 9, " "]) for _ in range(r.randint(0, 60))) for _ in range(60)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunks.sentence_pack("t", 40).alias("p")).collect()
    for i, parts in rows:
        want = None if texts[i] is None else []
        for p in re.split(r"(?<=[.!?])\s+|(?<=,)\s+", texts[i] or ""):
            if p.strip(" ") and want is not None:
                if want and len(want[-1]) + 1 + len(p) <= 40:
                    want[-1] += " " + p
                else:
                    want.append(p)
        assert (parts or []) == (want or [])


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    store = tables.VectorTable(spark, f"file://{tmp_path}/t")
    schema = "file_id string, bucket_name string, text string"
    store.append(spark.createDataFrame([("a1", "x", "1"), ("b2", "y z/%", "2"), ("c3", "w", "3"), ("d4", None, "4")], schema))
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet")}
    before = files()
    store.upsert(spark.createDataFrame([("a1", "x", "new"), ("c3", "x", "moved")], schema))
    assert len(before & files()) == 2
    assert sorted((r.file_id, r.bucket_name, r.text) for r in store.read().collect()) == [("a1", "x", "new"), ("b2", "y z/%", "2"), ("c3", "x", "moved"), ("d4", None, "4")]
    store.delete("file_id", "b-2")
    store.delete("file_id", "d4")
    store.delete("file_id", "unknown")
    assert sorted(r.file_id for r in store.read().collect()) == ["a1", "c3"]


def test_late_rows_are_dropped_and_streams_join(spark, tmp_path):
    rows = lambda *times: spark.createDataFrame([(t, "a", 1.0) for t in times], "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    source, store = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows("2024-01-01 00:05:00", "2024-01-01 00:50:00").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(rows().schema).parquet(source)
        found = events.sliding(stream, "20 minutes", "10 minutes", "5 minutes", "ts", ["kind"], "value")
        found.writeStream.outputMode("append").option("checkpointLocation", f"{store}-c").trigger(availableNow=True).format("parquet").start(store).awaitTermination()

    run()
    rows("2024-01-01 00:06:00", "2024-01-01 02:00:00").coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    got = {(r.window_start.strftime("%H:%M"), r.n) for r in spark.read.parquet(store).collect()}
    assert got == {("23:50", 1), ("00:00", 1), ("00:40", 1), ("00:50", 1)}
    a = rows("2024-01-01 00:00:00", "2024-01-01 01:00:00").select("kind", F.col("ts").alias("l"))
    b = rows("2024-01-01 00:10:00", "2024-01-01 00:59:59").select("kind", F.col("ts").alias("r"))
    assert events.within(a, b, ["kind"], "l", "r", "15 minutes", "1 hour").count() == 1


def test_slots_follow_the_store(spark):
    """A store that has outgrown its slots is dealt anew, once; replays change nothing."""
    from ragweave.storage import fresh_path

    source, store = fresh_path(spark, "notices"), fresh_path(spark, "store")
    keys = ["bucket_name", "object_name", "action", "etag", "size", "event_time", "sequencer"]
    rows = lambda a, b, at, action="put": spark.range(a, b).selectExpr("'b' bucket_name", "concat('o', id) object_name", f"'{action}' action", "'e' etag", "id size", f"timestamp_seconds({at}) event_time", "'1' sequencer")

    def run():
        stream = spark.readStream.schema(rows(0, 1, 0).schema).option("maxFilesPerTrigger", 1).parquet(source)
        events.maintain(stream.select(*keys), store, f"{store}-{uuid.uuid4().hex}", slots=2, per_slot=10).awaitTermination()
        return sorted(r.size for r in events.catalogue(spark, store).collect())

    rows(0, 200, 1).coalesce(1).write.mode("append").parquet(source)
    assert run() == list(range(200)) and events._size(spark, store) == 2
    rows(190, 210, 2).coalesce(1).write.mode("append").parquet(source)
    rows(0, 5, 3, "delete").coalesce(1).write.mode("append").parquet(source)
    assert run() == list(range(5, 210)) and events._size(spark, store) == 16
    assert run() == list(range(5, 210))


def test_reranking_requests(spark):
    df = spark.createDataFrame([("a", "q", "x", 0, 0.2), ("a", "q", "y", 1, 0.9), ("b", "q", "", 0, 0.5), ("b", "q", "z", 1, 0.5), ("c", "q", "u", 0, None), ("c", "q", "v", 1, None)], "query_id string, query string, text string, position int, score double")
    kept = rerank.answerable(df)
    assert {r.query_id for r in kept.collect()} == {"a", "c"}
    assert sorted((r.query_id, r.text, r["rank"]) for r in rerank.top_or_all(kept, 1).collect()) == [("a", "y", 1), ("c", "u", 1), ("c", "v", 2)]
    assert [r.score for r in rerank.scored(df.drop("score"), lambda q, t: []).collect()] == [None] * 6
    with pytest.raises(Exception, match="blank"):
        rerank.answerable(df.withColumn("query", F.lit("  "))).collect()
