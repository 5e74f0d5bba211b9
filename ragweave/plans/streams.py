"""Queries of event streams; SQL gives the batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.plans.registry import query, table
from ragweave.storage import fresh_path
from ragweave.streaming import events, jobs


_ACTION = "CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'put' ELSE 'delete' END"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as storage notifications: a user is a bucket, ten objects each."""
    kind = F.when(F.col("event_type").isin("view", "click", "signup"), "s3:ObjectCreated:Put").otherwise("s3:ObjectRemoved:Delete")
    record = F.struct(
        kind.alias("eventName"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("eventTime"),
        F.struct(F.struct(F.concat(F.lit("b"), "user_id").alias("name")).alias("bucket"), F.struct(F.concat(F.lit("o"), F.col("event_id") % 10).alias("key"), F.col("event_id").alias("size"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sequencer")).alias("object")).alias("s3"),
    )
    return table(spark, sf_dir, "events").select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("value"))


@query(f"""SELECT 'b' || user_id AS bucket_name, 'o' || event_id % 10 AS object_name, event_id AS size FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 10 ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND {_ACTION} = 'put'""")
def events_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of notification files folded into the catalogue, two files at a time."""
    source, store = fresh_path(spark, "messages"), fresh_path(spark, "catalogue")
    _messages(spark, sf_dir).repartition(4).write.parquet(source)
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).parquet(source)
    events.maintain(events.storage_events(stream), store, store + "-checkpoint").awaitTermination()
    return events.catalogue(spark, store).select("bucket_name", "object_name", "size")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.tumbling(table(spark, sf_dir, "events"), "1 hour", "10 minutes", "ts", ["event_type"], "value")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, g""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.sessions(table(spark, sf_dir, "events"), "30 minutes", "10 minutes", "ts", "user_id")
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def events_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("""SELECT user_id AS request_id, round((epoch_us(min(ts)) - epoch_us(TIMESTAMP '2020-01-01')) / 1000.0, 3)::DOUBLE AS first_ms, round(CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 / (count(*) - 1) END, 3)::DOUBLE AS next_ms FROM events GROUP BY user_id""")
def token_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), "ts", F.lit("2020-01-01").cast("timestamp").alias("started"))
    return events.token_latency(rows).select("request_id", F.round("first_ms", 3).alias("first_ms"), F.round("next_ms", 3).alias("next_ms"))


@query("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '20 minutes', ts), time_bucket(INTERVAL '20 minutes', ts) - INTERVAL '20 minutes', time_bucket(INTERVAL '20 minutes', ts) - INTERVAL '40 minutes']) AS window_start FROM events)
    SELECT window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY ALL""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that begin every twenty minutes."""
    found = events.sliding(table(spark, sf_dir, "events"), "1 hour", "20 minutes", "10 minutes", "ts", ["event_type"], "value")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def events_tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling windows of a stream of files; a window is given out when the watermark has passed it.

    The files are one batch, so none of their rows is late; a last row moves the watermark beyond all windows
    and belongs to none that is given out.
    """
    source, store = fresh_path(spark, "timed"), fresh_path(spark, "windows")
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    for part in (rows, rows.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).select("ts", F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))):
        part.write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    found = events.tumbling(stream, "1 hour", "1 day", "ts", ["event_type"], "value")
    found.writeStream.outputMode("append").option("checkpointLocation", store + "-checkpoint").trigger(availableNow=True).format("parquet").start(store).awaitTermination()
    made = spark.read.schema(found.schema).parquet(store)
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL '30 minutes'""")
def events_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the purchases of the same user in the half hour after them, as a join of two streams."""
    source, store = fresh_path(spark, "joined"), fresh_path(spark, "pairs")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(source)
    side = lambda kind, key, at: spark.readStream.schema(rows.schema).parquet(source).filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(key), F.col("ts").alias(at))
    found = events.within(side("click", "click_id", "clicked"), side("purchase", "purchase_id", "bought"), ["user_id"], "clicked", "bought", "30 minutes", "1 day").select("click_id", "purchase_id")
    found.writeStream.outputMode("append").option("checkpointLocation", store + "-checkpoint").trigger(availableNow=True).format("parquet").start(store).awaitTermination()
    return spark.read.schema(found.schema).parquet(store)


@query("""WITH s AS (SELECT user_id AS job_id, sum(event_id % 3)::BIGINT AS done, max(event_id % 40)::BIGINT AS total FROM events GROUP BY user_id)
    SELECT job_id, done, total, round(CASE WHEN total > 0 THEN least(done / total, 1) ELSE 1 END, 6)::DOUBLE AS share, done >= total AS finished FROM s""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs whose events report finished chunks."""
    batches = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 3).alias("n_done"), (F.col("event_id") % 40).alias("n_total"))
    return events.progress(batches).withColumn("share", F.round("share", 6))


#: Events as commands of their user's job.
_COMMAND = """CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'start' WHEN 'view' THEN 'progress' WHEN 'error' THEN 'fail'
    ELSE CASE event_id % 3 WHEN 0 THEN 'cancel' WHEN 1 THEN 'retry' ELSE 'delete' END END"""
_PURGE = 3600


@query(f"""WITH c AS (SELECT user_id::VARCHAR AS id, epoch_us(ts) AS us, event_id AS number, {_COMMAND} AS kind, CASE WHEN event_type = 'click' THEN event_id % 3 + 1 ELSE 1 END AS n FROM events),
    l AS (SELECT id, list_prepend({{'us': -1::BIGINT, 'kind': '', 'n': 0::BIGINT, 'status': NULL::VARCHAR, 'processed': 0::BIGINT, 'total': 0::BIGINT, 'attempt': 0, 'purge': 0::BIGINT}},
        list({{'us': us, 'kind': kind, 'n': n::BIGINT, 'status': NULL::VARCHAR, 'processed': 0::BIGINT, 'total': 0::BIGINT, 'attempt': 0, 'purge': 0::BIGINT}} ORDER BY us, number)) AS log FROM c GROUP BY id),
    f AS (SELECT id, list_reduce(log, lambda a, x: CASE
        WHEN x.kind = 'submit' AND (a.status IS NULL OR a.status <> 'deleting' OR x.us >= a.purge) THEN struct_update(x, status := 'uploaded', attempt := 1)
        WHEN a.status IS NULL OR (a.status = 'deleting' AND x.us < a.purge) THEN a
        WHEN a.status = 'deleting' OR a.status = 'purged' THEN struct_update(a, status := 'purged')
        WHEN x.kind = 'retry' THEN struct_update(x, status := 'uploaded', attempt := a.attempt + 1)
        WHEN x.kind = 'delete' THEN struct_update(a, status := 'deleting', purge := x.us + {_PURGE * 1_000_000})
        WHEN a.status NOT IN ('uploaded', 'processing') THEN a
        WHEN x.kind = 'start' THEN struct_update(a, status := 'processing', processed := 0, total := x.n)
        WHEN x.kind = 'progress' AND a.status = 'processing' THEN struct_update(a, status := CASE WHEN a.processed + x.n >= a.total THEN 'ingested' ELSE 'processing' END, processed := least(a.processed + x.n, a.total))
        WHEN x.kind = 'fail' THEN struct_update(a, status := 'error') WHEN x.kind = 'cancel' THEN struct_update(a, status := 'canceled') ELSE a END) AS s FROM l)
    SELECT id, CASE s.status WHEN 'deleting' THEN 'purged' ELSE s.status END AS status, s.processed::BIGINT AS processed, s.total::BIGINT AS total, s.attempt::INTEGER AS attempt FROM f WHERE s.status IS NOT NULL""")
def job_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user's job, from a stream of commands in shuffled files; a last row moves the watermark on."""
    source, store = fresh_path(spark, "commands"), fresh_path(spark, "jobs")
    e = table(spark, sf_dir, "events")
    kind = F.expr(_COMMAND)
    n = F.when(F.col("event_type") == "click", F.col("event_id") % 3 + 1).otherwise(1)
    rows = e.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("number"), kind.alias("kind"), n.cast("long").alias("n"))
    end = rows.agg((F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("at")).select(F.lit("end").alias("id"), "at", F.lit(0).cast("long").alias("number"), F.lit("fail").alias("kind"), F.lit(0).cast("long").alias("n"))
    rows.repartition(F.xxhash64("number")).write.parquet(source)
    end.write.mode("append").parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(source)
        found = jobs.transitions(stream, "10 minutes", _PURGE)
        found.writeStream.outputMode("append").option("checkpointLocation", store + "-checkpoint").trigger(availableNow=True).format("parquet").start(store).awaitTermination()
    finally:
        spark.conf.set(name, before)
    made = spark.read.schema(found.schema).parquet(store)
    last = made.groupBy("id").agg(F.max_by(F.struct("status", "processed", "total", "attempt"), F.struct("at_us", "number")).alias("s"))
    return last.select("id", "s.status", "s.processed", "s.total", "s.attempt")
