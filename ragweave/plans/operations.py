"""Queries of the catalogue, statistics, history, prompts and pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragweave.functions import nested
from ragweave.functions import text as X
from ragweave.operators import catalog, hash_tree, models, prompts, quantiles, records, stats
from ragweave.operators.table_log import LogTable
from ragweave.plans import pipeline
from ragweave.plans.registry import query, table
from ragweave.storage import fresh_path, materialize


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("bucket_name"), F.format_string("doc-%d.txt", "doc_id").alias("object_name"), F.md5(F.col("text").cast("binary")).alias("etag"), F.col("n_chars").alias("size"), "doc_id")


_OBJECTS = "o AS (SELECT source AS bucket_name, 'doc-' || doc_id || '.txt' AS object_name, md5(text) AS etag, n_chars AS size, doc_id FROM documents)"


@query(f"""WITH {_OBJECTS}, s AS (SELECT * FROM o WHERE doc_id % 11 <> 0), c AS (SELECT bucket_name, object_name, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE etag END AS etag, size FROM o WHERE doc_id % 13 <> 0)
    SELECT coalesce(s.bucket_name, c.bucket_name) AS bucket_name, coalesce(s.object_name, c.object_name) AS object_name,
    CASE WHEN c.object_name IS NULL THEN 'add' WHEN s.object_name IS NULL THEN 'delete' WHEN s.etag IS DISTINCT FROM c.etag OR s.size IS DISTINCT FROM c.size THEN 'update' ELSE 'no action' END AS action
    FROM s FULL JOIN c ON s.bucket_name = c.bucket_name AND s.object_name = c.object_name""")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage lacks every 11th object, the catalogue every 13th and has an old etag for every 7th."""
    o = _objects(spark, sf_dir)
    known = o.filter("doc_id % 13 <> 0").withColumn("etag", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("etag")))
    return catalog.sync(o.filter("doc_id % 11 <> 0"), known).select("bucket_name", "object_name", "action")


@query(f"""WITH {_OBJECTS}, s AS (SELECT * FROM o WHERE doc_id % 211 <> 0), c AS (SELECT bucket_name, object_name, CASE WHEN doc_id % 197 = 0 THEN 'old' ELSE etag END AS etag, size FROM o WHERE doc_id % 223 <> 0)
    SELECT coalesce(s.bucket_name, c.bucket_name) AS bucket_name, coalesce(s.object_name, c.object_name) AS object_name,
    CASE WHEN c.object_name IS NULL THEN 'add' WHEN s.object_name IS NULL THEN 'delete' ELSE 'update' END AS action
    FROM s FULL JOIN c ON s.bucket_name = c.bucket_name AND s.object_name = c.object_name WHERE c.object_name IS NULL OR s.object_name IS NULL OR s.etag IS DISTINCT FROM c.etag""")
def sync_by_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage and catalogue that differ in few objects, by their hash trees."""
    o = _objects(spark, sf_dir).withColumn("size", F.col("size").cast("long"))
    known = o.filter("doc_id % 223 <> 0").withColumn("etag", F.when(F.col("doc_id") % 197 == 0, "old").otherwise(F.col("etag")))
    paths = [fresh_path(spark, "tree") for _ in range(2)]
    for rows, path in zip((o.filter("doc_id % 211 <> 0"), known), paths):
        hash_tree.keep(rows, path, depth=2)
    return hash_tree.changes(spark, *paths).select("bucket_name", "object_name", "action")


@query("SELECT doc_id, text IS NOT NULL AS there FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def catalog_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.gone(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ("doc_id",))
    return rows.select("doc_id", F.col("text").isNotNull().alias("there"))


_STATUS = "CASE WHEN event_type = 'purchase' THEN 'ingested' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'processing' ELSE 'uploaded' END"


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "ingested").when(kind == "error", "error").when(kind == "view", "processing").otherwise("uploaded")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", status.alias("status"), (F.col("user_id") % 5 == 0).alias("marked_for_deletion"), (F.col("event_id") % 20).alias("chunks_total"), (F.col("event_id") % 7).alias("chunks_processed"))


@query(f"""WITH s AS (SELECT unnest({list(catalog.STATUSES)}) AS status), e AS (SELECT {_STATUS} AS status FROM events)
    SELECT s.status, count(e.status) AS n FROM s LEFT JOIN e ON s.status = e.status GROUP BY s.status""")
def status_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.status_counts(_catalogue(spark, sf_dir), spark)


@query("""SELECT count(*) FILTER (WHERE user_id % 5 <> 0) AS n_live, count(*) FILTER (WHERE user_id % 5 = 0) AS n_deleted, sum(event_id % 20)::BIGINT AS chunks_total, sum(event_id % 7)::BIGINT AS chunks_processed FROM events""")
def chunk_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.totals(_catalogue(spark, sf_dir))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER w AS n, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM b""")
def skip_duplicate_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.changes_only(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type").select("user_id", "event_id", "event_type")


@query("""WITH n AS (SELECT user_id AS id, event_id, ts FROM events WHERE event_type = 'signup')
    SELECT e.event_id, e.user_id, coalesce(e.user_id IN (SELECT id FROM n), false) OR e.user_id % 5 = 0 AS marked_for_deletion, CASE WHEN e.event_type = 'purchase' THEN 'ingested' WHEN e.event_type = 'error' THEN 'error' WHEN e.event_type = 'view' THEN 'processing' ELSE 'uploaded' END AS status FROM events e
    UNION ALL SELECT event_id, id, false, 'uploaded' FROM n""")
def replace_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup replaces all rows of its user: those are marked, it comes in as uploaded."""
    fresh = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", "user_id")
    return catalog.replaced(_catalogue(spark, sf_dir), fresh, ["user_id"]).select("event_id", "user_id", "marked_for_deletion", "status")


@query("""SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.latency(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p99")])


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
    j AS (SELECT *, greatest(1, least((9 * (n + 1)) // 10, n - 1)) AS j, 9 * (n + 1) - 10 * greatest(1, least((9 * (n + 1)) // 10, n - 1)) AS d FROM v)
    SELECT event_type, round(CASE WHEN any_value(n) > 1 THEN (max(value) FILTER (WHERE i = j) * (10 - any_value(d)) + max(value) FILTER (WHERE i = j + 1) * any_value(d)) / 10 END, 4) AS p90,
    round(min(value), 4) AS least, round(max(value), 4) AS most, round(var_samp(value), 3) AS variance FROM j GROUP BY event_type""")
def http_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    more = e.groupBy("event_type").agg(F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"), F.round(F.var_samp("value"), 3).alias("variance"))
    return stats.exclusive_p90(e, ["event_type"], "value").withColumn("p90", F.round("p90", 4)).join(more, "event_type")


@query(f"""WITH b AS (SELECT unnest({[float(b) for b in stats.BOUNDS]}::DOUBLE[]) AS le UNION ALL SELECT NULL), t AS (SELECT DISTINCT event_type FROM events)
    SELECT t.event_type, b.le, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND e.value IS NOT NULL AND (b.le IS NULL OR e.value <= b.le)) AS n FROM t, b""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""WITH r AS (SELECT (event_id % 50)::DOUBLE AS inputs, (event_id % 9)::DOUBLE AS outputs, value / 10 AS first, value / 10 + event_id % 30 AS last FROM events),
    x AS (SELECT *, CASE WHEN outputs > 0 THEN (last - first) / outputs END AS nxt FROM r)
    SELECT round(avg(inputs), 4) AS inputs_mean, round(quantile_cont(inputs, 0.9), 4) AS inputs_p90, round(avg(nxt), 4) AS next_mean, round(quantile_cont(nxt, 0.9), 4) AS next_p90, round(32 / avg(nxt), 4) AS tokens_per_second FROM x""")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 50).cast("double").alias("inputs"), (F.col("event_id") % 9).cast("double").alias("outputs"), (F.col("value") / 10).alias("first"), (F.col("value") / 10 + F.col("event_id") % 30).alias("last"))
    found = stats.load_test(rows, 32)
    return found.select(*[F.round(c, 4).alias(c) for c in ("inputs_mean", "inputs_p90", "next_mean", "next_p90", "tokens_per_second")])


@query("""WITH e AS (SELECT event_type, value FROM events WHERE value IS NOT NULL), n AS (SELECT event_type, count(*) AS n FROM e GROUP BY event_type), s AS (SELECT unnest([0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS share)
    SELECT event_type, share, n, true AS within FROM n, s""")
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each hour and kind, merged by kind; ``within``: the counted rank error is at most two per cent."""
    e = table(spark, sf_dir, "events")
    hours = materialize(quantiles.sketches(e, ["event_type", F.date_trunc("hour", "ts").alias("hour")], "value"), "hour-sketches")
    found = quantiles.sketch_quantiles(quantiles.merged_sketches(hours, ["event_type"]), ["event_type"], [0.1, 0.5, 0.9, 0.99])
    errors = quantiles.rank_errors(e, ["event_type"], "value", materialize(found, "sketch-quantiles"))
    return errors.select("event_type", "share", "n", (F.col("rank_error") <= 0.02).alias("within"))


@query("""WITH d AS (SELECT doc_id, source, n_chars::BIGINT AS n FROM documents), k AS (SELECT * FROM d WHERE source IS DISTINCT FROM 'src3' AND doc_id % 10 <> 0)
    SELECT 2::BIGINT AS version, doc_id, source, n FROM d
    UNION ALL SELECT 5, doc_id, source, n FROM (FROM k UNION ALL SELECT doc_id, source, n + 1 FROM d WHERE doc_id % 10 = 0)""")
def table_log_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, a delete by source, an upsert of every tenth document and a compaction: the rows before and after."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("long").alias("n"))
    held = LogTable.create(spark, fresh_path(spark, "table-log"), docs.schema)
    held.append(docs.filter("doc_id % 2 = 0"))
    before = held.append(docs.filter("doc_id % 2 = 1"))
    held.delete(F.col("source") == "src3")
    held.upsert(docs.filter("doc_id % 10 = 0").withColumn("n", F.col("n") + 1), ["doc_id"])
    after = held.compact()
    parts = [held.read(v.number).withColumn("version", F.lit(v.number).cast("long")) for v in (before, after)]
    return parts[0].unionByName(parts[1])


_PAIRS = """p AS (SELECT conv_id, turn, text AS question, nt AS answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM p) WHERE b <= 3)"""


@query(f"WITH {_PAIRS} SELECT conv_id, turn, b::INTEGER AS back, question FROM l")
def history_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.recent(prompts.exchanges(table(spark, sf_dir, "conversations"))).select("conv_id", "turn", "back", "question")


@query(f"WITH {_PAIRS} SELECT conv_id, trim(string_agg('User: ' || coalesce(question, '') || E'\\nAssistant: ' || coalesce(answer, ''), E'\\n' ORDER BY turn), ' ') AS history FROM l GROUP BY conv_id")
def history_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.history(prompts.exchanges(table(spark, sf_dir, "conversations")))


@query("SELECT conv_id, left(arg_min(text, turn), 30) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def history_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 30).alias("title"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, dense_rank() OVER (PARTITION BY lang ORDER BY source) AS c FROM documents),
    e AS (SELECT lang, rank, CASE WHEN source IS NULL OR source = '' THEN text ELSE '[' || c || '] (' || source || E')\\nContent: ' || text END AS e FROM d WHERE rank <= 5)
    SELECT lang, string_agg(e, E'\\n\\n' ORDER BY rank) AS context FROM e GROUP BY lang""")
def prompt_context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir)


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five first documents of each language as context; ids are ranked, only these bring their text."""
    docs = table(spark, sf_dir, "documents")
    top = docs.select("doc_id", "lang", "source", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("rank")).filter("rank <= 5")
    cited = docs.select(F.col("lang").alias("of"), F.col("source").alias("cited")).distinct()
    cited = cited.withColumn("citation_id", F.dense_rank().over(Window.partitionBy("of").orderBy(F.asc_nulls_last("cited"))))
    rows = top.join(cited, F.col("lang").eqNullSafe(F.col("of")) & F.col("source").eqNullSafe(F.col("cited"))).join(docs.select("doc_id", "text"), "doc_id")
    return prompts.context(rows, prompts.context_entry(), "lang")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, dense_rank() OVER (PARTITION BY lang ORDER BY source) AS c FROM documents),
    e AS (SELECT lang, rank, CASE WHEN source IS NULL OR source = '' THEN text ELSE '[' || c || '] (' || source || E')\\nContent: ' || text END AS e FROM d WHERE rank <= 5),
    a AS (SELECT lang, string_agg(e, E'\\n\\n' ORDER BY rank) AS context FROM e GROUP BY lang)
    SELECT lang, md5(context) AS context_md5, length(context)::BIGINT AS context_length FROM a""")
def prompt_context_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prompt_context_format`` as digests and lengths."""
    return _contexts(spark, sf_dir).select("lang", F.md5(F.col("context").cast("binary")).alias("context_md5"), F.length("context").cast("long").alias("context_length"))


@query("SELECT conv_id, turn, trim('Context: none' || E'\\n' || 'Question: ' || coalesce(text, '') || E'\\nHistory: ', ' ') AS prompt FROM conversations WHERE role = 'user'")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = "Context: none\nQuestion: {question}\nHistory: {conversation_history}"
    prompts.check_template(template, ["question"])
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", prompts.render(template, {"question": "text"}).alias("prompt"))


@query("""WITH d AS (SELECT *, lead(lang) OVER (ORDER BY doc_id) AS q FROM documents) SELECT doc_id, q AS target_lang, CASE WHEN lang = q THEN 'en' ELSE lang END AS source_lang FROM d WHERE q IS NOT NULL""")
def translation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question's language is that of the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("answer_lang"))
    rows = prompts.with_next(docs, "doc_id", "answer_lang", "question_lang").filter("question_lang is not null")
    return prompts.translation_languages(rows).select("doc_id", "target_lang", "source_lang")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, array_to_string(flatten(list_transform(range(0, len(w), 400), lambda f: w[f + 1 : f + 12]))[1:12], ' ') AS summary FROM w WHERE len(w) > 0""")
def summaries_map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in summaries of documents by the words that begin their chunks."""
    from ragweave.operators import chunks

    made = chunks.fixed_tokens(table(spark, sf_dir, "documents"), 400, 0).withColumnRenamed("chunk_text", "text")
    return models.summarize(made, models.first_words(12))


@query("""WITH c AS (SELECT * FROM (VALUES ('de', ['der', 'die', 'und', 'das', 'ein', 'nicht']), ('en', ['the', 'and', 'of', 'to', 'was', 'is']), ('es', ['el', 'de', 'que', 'y', 'los', 'una']), ('fr', ['le', 'la', 'et', 'les', 'des', 'une'])) AS c(l, words)),
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
    v AS (SELECT doc_id, l, len(list_filter(w, lambda x: list_contains(words, x))) AS n FROM w, c)
    SELECT doc_id, l AS language FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, l) AS k FROM v) WHERE k = 1""")
def langdetect_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in language detection by common words."""
    common = {"de": ["der", "die", "und", "das", "ein", "nicht"], "en": ["the", "and", "of", "to", "was", "is"], "es": ["el", "de", "que", "y", "los", "una"], "fr": ["le", "la", "et", "les", "des", "une"]}
    return models.language_votes(table(spark, sf_dir, "documents"), common).select("doc_id", "language")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN upper(source) ELSE source END AS source, lang = 'en' AND n_chars > 1000 AS long FROM documents")
def pipeline_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps for English rows; the others come out as they are."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.lit(False).alias("long"))
    steps = [(lambda d: d.withColumn("source", F.upper("source")), F.col("lang") == "en"), (lambda d: d.withColumn("long", F.col("n_chars") > 1000), None)]
    return pipeline.sequence(rows, steps).select("doc_id", "source", "long")


@query("SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'long' WHEN lang = 'fr' THEN 'french' ELSE 'plain' END AS kind FROM documents")
def pipeline_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.lit("plain").alias("kind"))
    branches = [(F.col("lang") == "fr", lambda d: d.withColumn("kind", F.lit("french"))), (F.col("n_chars") > 2000, lambda d: d.withColumn("kind", F.lit("long")))]
    return pipeline.switch(rows, branches).select("doc_id", "kind")


@query("SELECT doc_id, upper(lang) AS name, n_chars * 2 AS size FROM documents")
def pipeline_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = {"named": lambda d: d.select("doc_id", F.upper("lang").alias("name")), "sized": lambda d: d.select("doc_id", (F.col("n_chars") * 2).alias("size"))}
    found = pipeline.ensemble(table(spark, sf_dir, "documents"), branches, ["doc_id"])
    return found.select("doc_id", "named.name", "sized.size")


@query("""SELECT 'conv-' || conv_id || '.txt' AS filename, turn, text AS prompt_text FROM conversations WHERE contains(text, 'the th') AND role = 'user'""")
def prompt_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as stored prompts, by a part of their text."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.format_string("conv-%d.txt", "conv_id").alias("filename"), "turn", F.col("text").alias("prompt_text"))
    return records.find_prompts(rows, text="the th")


@query("""SELECT conv_id AS history_id, conv_id % 7 AS user_id, CASE WHEN conv_id % 7 = 3 AND conv_id = 10 THEN 'renamed' ELSE 'chat ' || conv_id END AS name, len(list(text)) AS n
    FROM conversations WHERE NOT (conv_id % 7 = 4 AND conv_id = 11) GROUP BY conv_id""")
def history_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of seven users: one renamed by its owner, one removed; others' requests change nothing."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("history_id")).agg(F.count("*").alias("n"))
    rows = rows.select("history_id", (F.col("history_id") % 7).alias("user_id"), F.format_string("chat %d", "history_id").alias("name"), "n")
    rows = records.renamed(records.renamed(rows, "3", "10", "renamed"), "5", "10", "stolen")
    return records.removed(records.removed(rows, "4", "11"), "6", "12")


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars > 100) AS n_ready, CASE WHEN count(*) = count(*) FILTER (WHERE n_chars > 100) THEN 'Ready' ELSE 'Failed' END AS status FROM documents GROUP BY source""")
def readiness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.readiness(table(spark, sf_dir, "documents"), "source", F.col("n_chars") > 100)


@query("""WITH r AS (SELECT 'doc-' || doc_id AS file_name, n_chars AS file_size, n_chars // 500 AS total_chunks, n_chars % 100 AS extraction, n_chars % 77 AS embedding FROM documents)
    SELECT *, extraction + embedding AS total FROM r UNION ALL SELECT 'TOTAL', sum(file_size)::BIGINT, sum(total_chunks)::BIGINT, sum(extraction)::BIGINT, sum(embedding)::BIGINT, sum(extraction + embedding)::BIGINT FROM r""")
def ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select(F.format_string("doc-%d", "doc_id").alias("file_name"), c.alias("file_size"), F.floor(c / 500).alias("total_chunks"), (c % 100).alias("extraction"), (c % 77).alias("embedding"))
    return stats.ingestion_report(rows, ["extraction", "embedding"])


@query("""SELECT doc_id, concat_ws(' ', doc_id::VARCHAR, nullif(lang, ''), nullif(source, ''), n_chars::VARCHAR) AS flat FROM documents""")
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of nested rows as text, after the key ``id`` is dropped at every depth."""
    inner = F.struct(F.lit("gone").alias("id"), "lang", F.array(F.struct(F.lit(0).alias("id"), "source", "n_chars")).alias("parts"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.struct("doc_id", inner.alias("inner"), F.lit("x").alias("id")).alias("row"))
    rows = nested.drop_key(rows, "row", "id")
    return rows.select("doc_id", nested.flatten_text(F.col("row"), rows.schema["row"].dataType).alias("flat"))


@query("""SELECT doc_id, source AS own, lang AS lang FROM documents""")
def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's map and a chunk's, whose entries win."""
    low, high = F.create_map(F.lit("lang"), "lang", F.lit("own"), F.lit("document")), F.create_map(F.lit("own"), "source")
    rows = table(spark, sf_dir, "documents").select("doc_id", nested.merge_maps(low, high).alias("m"))
    return rows.select("doc_id", F.col("m")["own"].alias("own"), F.col("m")["lang"].alias("lang"))


@query("""WITH h AS (SELECT page_id, url, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)
    SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id, url_encode(url) AS quoted FROM h""")
def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 5 UUIDs and quoted forms of addresses."""
    return table(spark, sf_dir, "pages").select("page_id", X.name_uuid("url", "url").alias("id"), F.url_encode("url").alias("quoted"))


@query("""SELECT event_id, epoch_us(ts) / 1e6::DOUBLE AS seconds, (event_id % 10)::DOUBLE AS number, event_id % 3 = 0 AS flag FROM events""")
def coerced_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as text, quoted or not, back as numbers and flags; times as seconds."""
    e = table(spark, sf_dir, "events")
    number = X.setting(F.concat(F.lit('"'), (F.col("event_id") % 10).cast("string"), F.lit('"')))["number"]
    flag = X.setting(F.when(F.col("event_id") % 3 == 0, " True").otherwise("'false'"))["flag"]
    return e.select("event_id", X.epoch_seconds("ts").alias("seconds"), number.alias("number"), flag.alias("flag"))
