"""Storage events into the catalogue, and windows over event streams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragweave.storage import discard, file_system, materialize, remove

RECORDS = "Records array<struct<eventName: string, eventTime: string, s3: struct<bucket: struct<name: string>, object: struct<key: string, size: bigint, eTag: string, sequencer: string>>>>"


def storage_events(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """All records of notification messages: bucket_name, object_name, action, etag, size, event_time, sequencer."""
    records = raw.select(F.explode(F.from_json(F.col(value_col).cast("string"), RECORDS)["Records"]).alias("r"))
    kind = F.col("r.eventName")
    action = F.when(kind.contains("ObjectCreated"), "put").when(kind.contains("ObjectRemoved"), "delete").otherwise("unknown")
    return records.select(
        F.col("r.s3.bucket.name").alias("bucket_name"),
        F.url_decode("r.s3.object.key").alias("object_name"),
        action.alias("action"),
        F.col("r.s3.object.eTag").alias("etag"),
        F.col("r.s3.object.size").alias("size"),
        F.col("r.eventTime").cast("timestamp").alias("event_time"),
        F.col("r.s3.object.sequencer").alias("sequencer"),
    )


def path_events(raw: DataFrame, path_col: str = "path") -> DataFrame:
    """Events that name a whole path: bucket_name is its first part, object_name the rest."""
    bare = F.ltrim(F.col(path_col), F.lit("/"))
    return raw.withColumns({"bucket_name": F.regexp_extract(bare, r"^([^/]+)", 1), "object_name": F.regexp_extract(bare, r"^[^/]+/(.*)$", 1)})


def fold(state: DataFrame | None, events: DataFrame) -> DataFrame:
    """The newest event of each object, over the state so far and a batch; replays change nothing."""
    columns = ["bucket_name", "object_name", "action", "etag", "size", "event_time", "sequencer"]
    both = events.select(*columns) if state is None else state.select(*columns).unionByName(events.select(*columns))
    newest = Window.partitionBy("bucket_name", "object_name").orderBy(F.desc("event_time"), F.desc("sequencer"), F.desc("action"))
    return both.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")


#: Slots that a new store has, and objects of a slot; a store with twice as many objects gets more slots.
SLOTS, PER_SLOT = 16, 4096


def maintain(events: DataFrame, store: str, checkpoint: str, trigger: dict[str, object] | None = None, slots: int = SLOTS, per_slot: int = PER_SLOT) -> StreamingQuery:
    """Keep a table of the newest event per object under ``store``, in slots by a hash of the object.

    A batch folds its events into the slots they fall to and overwrites those only. The number of slots follows
    the store: when slots hold over twice ``per_slot`` objects on average, the next batch writes all objects
    to a folder with as many slots as they need (a power of two), which counts once it is complete; the older
    one goes. So a batch rewrites about ``per_slot`` objects for each slot that it touches.

    Folding takes the newest event whatever was folded before, so a batch that runs again, in part or whole,
    changes nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held, size = _state(spark, store), _size(spark, store) or slots
        objects = held.count() if held is not None else 0
        wanted = size
        while objects > 2 * wanted * per_slot:
            wanted *= 2
        slot = F.pmod(F.xxhash64("bucket_name", "object_name"), F.lit(wanted)).cast("int")
        now = materialize(batch.withColumn("slot", slot), "events")
        if wanted == size and held is not None:
            touched = [r[0] for r in now.select("slot").distinct().collect()]  # at most the number of slots
            held = held.filter(F.col("slot").isin(touched))
        folded = materialize(fold(held, now).withColumn("slot", slot), "folded")
        how = "dynamic" if wanted == size and held is not None else "static"  # a static write marks its folder as complete
        folded.repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("slot").parquet(f"{store}/slots={wanted}")
        if wanted != size:
            remove(spark, f"{store}/slots={size}")
        discard(now)
        discard(folded)

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _size(spark: SparkSession, store: str) -> int | None:
    """The slots of the store's complete folder; the larger one if an older one is left."""
    fs, make = file_system(spark, store)
    found = fs.globStatus(make(f"{store}/slots=*/_SUCCESS"))
    return max((int(x.getPath().getParent().getName().removeprefix("slots=")) for x in found or []), default=None)


def _state(spark: SparkSession, store: str) -> DataFrame | None:
    size = _size(spark, store)
    fs, make = file_system(spark, store)
    if size is None or not fs.globStatus(make(f"{store}/slots={size}/slot=*")):
        return None
    return spark.read.parquet(f"{store}/slots={size}")


def catalogue(spark: SparkSession, store: str) -> DataFrame | None:
    """Objects that exist now; None before the first batch."""
    state = _state(spark, store)
    return None if state is None else state.filter("action = 'put'").drop("slot")


def tumbling(events: DataFrame, width: str, late: str, time_col: str, group: list[str], value: str) -> DataFrame:
    """Counts and sums per window; with a stream, rows later than ``late`` are dropped."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark(time_col, late) if events.isStreaming else timed
    return timed.groupBy(F.window(time_col, width), *group).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *group, "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str, time_col: str, group: list[str], value: str) -> DataFrame:
    """As ``tumbling`` over windows of ``width`` that begin every ``step``."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark(time_col, late) if events.isStreaming else timed
    return timed.groupBy(F.window(time_col, width, step), *group).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *group, "n", "total")


def within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, reach: str, late: str) -> DataFrame:
    """Pairs of rows with equal ``keys`` where the right one comes at most ``reach`` after the left one.

    Of streams, both sides have a watermark, so that state that can't match any more goes.
    """
    sides = [d.withColumn(t, F.col(t).cast("timestamp")) for d, t in ((left, left_time), (right, right_time))]
    a, b = (d.withWatermark(t, late) if d.isStreaming else d for d, t in zip(sides, (left_time, right_time)))
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    near = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {reach}"))
    return a.join(b, [*same, near]).drop(*[f"__{k}" for k in keys])


def progress(batches: DataFrame, job: str = "job_id", done: str = "n_done", total: str = "n_total") -> DataFrame:
    """(job, done, total, share, finished) of jobs from rows that report batches of finished parts."""
    sums = batches.groupBy(job).agg(F.sum(done).cast("long").alias("done"), F.max(total).cast("long").alias("total"))
    share = F.when(F.col("total") > 0, F.least(F.col("done") / F.col("total"), F.lit(1.0))).otherwise(1.0)
    return sums.withColumns({"share": share, "finished": F.col("done") >= F.col("total")})


def sessions(events: DataFrame, gap: str, late: str, time_col: str, key: str) -> DataFrame:
    """Runs of a key's events with less than ``gap`` between them."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark(time_col, late) if events.isStreaming else timed
    return timed.groupBy(F.session_window(time_col, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def token_latency(chunks: DataFrame, request: str = "request_id", at: str = "ts") -> DataFrame:
    """First and mean next latency in ms of each request's chunks; ``started`` is when it was sent."""
    ms = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1000
    spans = chunks.groupBy(request).agg(F.min("started").alias("s"), F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"))
    return spans.select(request, ms("s", "a").alias("first_ms"), F.when(F.col("n") > 1, ms("a", "b") / (F.col("n") - 1)).alias("next_ms"))


def status_machine(changes: DataFrame) -> DataFrame:
    """Current status of each id from a log (id, ts, status): the newest, ties by the later state."""
    from ragweave.operators.catalog import STATUSES

    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return changes.groupBy("id").agg(F.max_by("status", F.struct("ts", rank)).alias("status"), F.max("ts").alias("since"))


def notification(bucket: str, key: str, name: str, at: str, size: int = 1, etag: str = "", sequencer: str = "") -> str:
    """A message as object stores send it, for tests and replays."""
    return json.dumps({"Records": [{"eventName": name, "eventTime": at, "s3": {"bucket": {"name": bucket}, "object": {"key": key, "size": size, "eTag": etag, "sequencer": sequencer}}}]})
