"""Versions, deletion bitmaps, writers at once, compaction and vacuum of the table log."""

import threading

import pytest
from pyspark.sql import functions as F

from ragweave.operators.table_log import LogTable
from ragweave.storage import fresh_path

KIND = "id long, file string, text string"


def rows(spark, a, b, note="x"):
    return spark.range(a, b).select("id", F.concat(F.lit("f"), F.col("id") % 5).alias("file"), F.lit(note).alias("text"))


def ids(df):
    return sorted(r.id for r in df.collect())


def files(spark, path):
    return {r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()}


def test_changes_and_snapshots(spark):
    t = LogTable.create(spark, fresh_path(spark, "log"), KIND)
    assert t.read().count() == 0 and t.read().columns == ["id", "file", "text"]
    with pytest.raises(ValueError):
        LogTable.create(spark, t.path, KIND)
    t.append(rows(spark, 0, 70_000).coalesce(1))  # more than two bitmaps a file
    before = files(spark, f"{t.path}/data")
    t.delete(F.col("id") % 10_000 == 7)
    t.delete((F.col("file") == "f1") & (F.col("id") > 40_000))
    assert files(spark, f"{t.path}/data") == before  # a delete writes bitmaps only
    gone = lambda i: i % 10_000 == 7 or (i % 5 == 1 and i > 40_000)
    left = [i for i in range(70_000) if not gone(i)]
    assert ids(t.read()) == left and ids(t.read(1)) == list(range(70_000)) and len(ids(t.read(2))) == 70_000 - 7
    t.upsert(rows(spark, 39_990, 40_010, "new"), ["id"])
    now = {r.id: r.text for r in t.read().collect()}
    assert len(now) == len(set(left) | set(range(39_990, 40_010))) and all(now[i] == "new" for i in range(39_990, 40_010)) and now[39_989] == "x"
    made = t.compact()
    assert not made.deletions and len(made.data) == 1 and {r.id: r.text for r in t.read().collect()} == now
    assert ids(t.read(1)) == list(range(70_000))
    assert [v.change for v in t.history()] == ["create", "append", "delete", "delete", "upsert", "compact"]
    t.vacuum(1)
    assert {r.id: r.text for r in t.read().collect()} == now and len(files(spark, f"{t.path}/data")) == len([f for f in files(spark, f"{t.path}/data") if made.data[0] in f])
    with pytest.raises(ValueError):
        t.read(1)
    with pytest.raises(ValueError):
        t.append(spark.range(1).selectExpr("id", "1 other"))


def test_odd_changes(spark):
    t = LogTable.create(spark, fresh_path(spark, "log"), KIND)
    t.append(rows(spark, 0, 0))
    t.append(spark.createDataFrame([(None, None), (1, "a")], "id long, text string"))
    t.delete(F.col("id") == F.lit(None).cast("long"))  # null deletes nothing
    assert t.read().count() == 2
    t.upsert(spark.createDataFrame([(None, "z", "w")], KIND), ["id"])
    assert sorted((str(r.id), r.text) for r in t.read().collect()) == [("1", "a"), ("None", "w")]
    t.delete(F.lit(True))
    assert t.read().count() == 0 and t.compact().counts == {"kept": 0}


def test_two_writers_lose_nothing_and_readers_see_whole_versions(spark):
    t = LogTable.create(spark, fresh_path(spark, "log"), KIND)
    t.append(rows(spark, 0, 1000))
    failed = []

    def run(work):
        def guarded():
            try:
                work(LogTable(spark, t.path))
            except Exception as e:  # told to the test
                failed.append(e)

        return threading.Thread(target=guarded)

    def appends(mine):
        for k in range(4):
            mine.append(rows(spark, 10_000 + 100 * k, 10_100 + 100 * k))

    def deletes(mine):
        for k in range(4):
            mine.delete(F.col("id").between(100 * k, 100 * k + 49))

    def upserts(mine):
        for k in range(3):
            mine.upsert(rows(spark, 600, 650, f"u{k}"), ["id"])

    def compacts(mine):
        for _ in range(2):
            mine.compact()

    seen = []

    def reads(mine):
        for _ in range(4):
            v = mine.version()
            seen.append((v, len(ids(mine.read(v.number))), len(ids(mine.read(v.number)))))

    workers = [run(f) for f in (appends, deletes, upserts, compacts, reads)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert not failed
    want = sorted([i for i in range(1000) if not (i < 400 and i % 100 < 50)] + list(range(10_000, 10_400)))
    assert ids(t.read()) == want
    assert {r.text for r in t.read().filter("id between 600 and 649").collect()} == {"u2"}
    assert all(a == b for _, a, b in seen)
    known = t.history()
    assert [v.number for v in known] == list(range(len(known))) and len(known) == 2 + 4 + 4 + 3 + 2
