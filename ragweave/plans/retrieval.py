"""Queries of vector search, filters, reranking, citations and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.functions import vectors as V
from ragweave.operators import chunks, filters, ranges, rerank, search, vector_index
from ragweave.plans.registry import query, table
from ragweave.storage import fresh_path

#: Distances by DuckDB over doubles.
SQL = {
    "cosine": "1 - list_cosine_similarity(e.embedding::DOUBLE[], q.v)",
    "l2": "list_distance(e.embedding::DOUBLE[], q.v)",
    "ip": "1 - list_inner_product(e.embedding::DOUBLE[], q.v)",
}
FIRST = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"


def _vector(rows: DataFrame, vec_id: int = 0) -> list[float]:
    return list(rows.filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _top(metric: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        return search.knn(e, _vector(e), 10, metric).select("vec_id", (F.round("distance", 5) + 0.0).alias("distance"))

    return run


for _metric, _name in (("cosine", "knn_cosine_topk"), ("l2", "knn_l2_topk"), ("ip", "knn_ip_topk")):
    query(f"WITH {FIRST} SELECT vec_id, round({SQL[_metric]}, 5) + 0.0 AS distance FROM embeddings e, q ORDER BY {SQL[_metric]}, vec_id LIMIT 10", _name)(_top(_metric))


@query(f"WITH {FIRST} SELECT vec_id, round({SQL['cosine']}, 5) AS distance FROM embeddings e, q WHERE {SQL['cosine']} <= 0.8 ORDER BY {SQL['cosine']}, vec_id LIMIT 20")
def knn_distance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.nearest_within(e, _vector(e), 20, 0.8).select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"WITH {FIRST} SELECT vec_id, label, round({SQL['cosine']}, 5) AS distance FROM embeddings e, q WHERE label IN (1, 3) ORDER BY {SQL['cosine']}, vec_id LIMIT 10")
def knn_filtered_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.knn(e, _vector(e), 10, where=F.col("label").isin(1, 3)).select("vec_id", "label", F.round("distance", 5).alias("distance"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {SQL['cosine'].replace('q.v', 'q.embedding::DOUBLE[]')} AS d
    FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, vec_id, round(d, 5) AS distance, rank FROM r WHERE rank <= 5""")
def knn_batch_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return search.knn_each(e, asked, 5).select("query_id", "vec_id", F.round("distance", 5).alias("distance"), "rank")


@query()
def ann_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate search by cells for the queries of ``knn_batch_topk_per_query``."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return search.knn_cells(e, asked, search.fit_cells(e, 16), 5, 12).select("query_id", "vec_id", F.round("distance", 5).alias("distance"), "rank")


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of ``knn_batch_topk_per_query`` by a persisted graph index over all rows."""
    e = table(spark, sf_dir, "embeddings")
    path = fresh_path(spark, "vector-index")
    vector_index.build(e, path, m=8, ef_construction=64)
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    found = vector_index.search(spark, path, asked, 5, ef_runtime=32)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"), "rank", "n_compared")


@query()
def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.search(e, _vector(e), "mmr", 5, fetch_k=20, lambda_mult=0.5).select("vec_id", "rank", F.round("score", 5).alias("score"))


@query(f"""WITH {FIRST}, h AS (SELECT vec_id, label, {SQL['cosine']} AS d FROM embeddings e, q ORDER BY d, vec_id LIMIT 5),
    s AS (SELECT vec_id, lag(vec_id) OVER w AS previous_id, lead(vec_id) OVER w AS next_id FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT h.vec_id, h.label, previous_id, next_id, round(d, 5) AS distance FROM h JOIN s USING (vec_id)""")
def knn_with_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("start", F.col("vec_id"))
    hits = search.search(e, _vector(e), "similarity_search_with_siblings", 5, file_cols=["label"], order_col="start")
    return hits.select("vec_id", "label", "previous_id", "next_id", F.round("distance", 5).alias("distance"))


@query(f"""WITH {FIRST}, c AS (SELECT label, list(a ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS a FROM (
        SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
    t AS (SELECT label FROM c, q ORDER BY 1 - list_cosine_similarity(c.v, q.v), label LIMIT 3),
    r AS (SELECT e.label, e.vec_id, {SQL['cosine']} AS d, row_number() OVER (PARTITION BY e.label ORDER BY {SQL['cosine']}, vec_id)::INTEGER AS rank
        FROM embeddings e JOIN t USING (label), q)
    SELECT label, vec_id, round(d, 5) AS distance, rank FROM r WHERE rank <= 2""")
def hierarchical_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label means are the summaries, their vectors the chunks."""
    e = table(spark, sf_dir, "embeddings")
    dims = len(_vector(e))
    means = e.groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"v{i}") for i in range(dims)])
    summaries = means.select("label", F.array(*[f"v{i}" for i in range(dims)]).alias("embedding"))
    found = search.hierarchical(summaries, e, _vector(e), 3, 2, ["label"])
    return found.select("label", "vec_id", F.round("distance", 5).alias("distance"), "rank")


@query("""WITH s AS (SELECT doc_id, source, (n_chars % 97) / 97.0::DOUBLE AS score FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s)
    SELECT source, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3 AND score > 0.02""")
def rerank_topn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") % 97 / F.lit(97.0)).alias("score"))
    return rerank.top_scored(scored, 3, 0.02, "source", "score", "doc_id").select("source", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id / 5.0 END AS distance FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(distance, 'infinity'::DOUBLE), doc_id)::INTEGER AS rank FROM d)
    SELECT source, doc_id, rank FROM r WHERE rank <= 4""")
def rerank_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") / 5).alias("distance"))
    return rerank.top_near(rows, 4, "source", "distance", "doc_id").select("source", "doc_id", "rank")


@query("""WITH h AS (SELECT lang AS query_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS rank, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source, doc_id FROM documents),
    f AS (SELECT *, min(rank) OVER (PARTITION BY query_id, coalesce(source, '')) AS first_rank FROM h)
    SELECT query_id, doc_id, dense_rank() OVER (PARTITION BY query_id ORDER BY first_rank)::INTEGER AS citation_id FROM f""")
def citation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("lang").alias("query_id"), "doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"))
    hits = ranges.numbered(rows, ["query_id"], "doc_id", "doc_id", "rank")
    return rerank.cite(hits, "source").select("query_id", "doc_id", "citation_id")


@query("""WITH h AS (SELECT doc_id, source, text FROM documents WHERE doc_id % 100 = 0),
    n AS (SELECT h.doc_id AS hit_id, h.source, d.doc_id AS s, d.text AS text FROM h JOIN documents d ON d.source = h.source AND d.doc_id BETWEEN h.doc_id - 20 AND h.doc_id + 20),
    c AS (SELECT source, hit_id, string_agg(text, ' ' ORDER BY s, text) AS combined_text FROM n GROUP BY source, hit_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, combined_text ORDER BY hit_id) AS n FROM c)
    SELECT source, hit_id, combined_text FROM r WHERE n = 1""")
def combine_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits: documents whose id is divisible by 100; siblings: up to 20 ids away in the same source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    hits = docs.filter("doc_id % 100 = 0").select(F.col("source"), F.col("doc_id").alias("hit_id"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("start_index"), "text")
    reach = hits.select("source", "hit_id", F.explode(F.expr("sequence(hit_id - 20, hit_id + 20)")).alias("doc_id")).filter("doc_id <> hit_id")
    near = reach.join(docs, ["source", "doc_id"]).select("source", "hit_id", F.col("doc_id").alias("start_index"), "text")
    return rerank.merge_siblings(hits, near, "source").select("source", "hit_id", "combined_text")


@query("""WITH n AS (SELECT h.doc_id AS hit_id, h.source, d.doc_id AS s, d.text FROM documents h JOIN documents d ON d.source = h.source AND d.doc_id BETWEEN h.doc_id - 20 AND h.doc_id + 20),
    c AS (SELECT source, hit_id, coalesce(string_agg(text, ' ' ORDER BY s, text), '') AS t FROM n GROUP BY source, hit_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, t ORDER BY hit_id) AS n FROM c)
    SELECT source, hit_id, md5(t) AS combined_md5, length(t)::BIGINT AS combined_length FROM r WHERE n = 1""")
def combine_siblings_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``combine_siblings``, as digests; every document is a hit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    hits = docs.select("source", F.col("doc_id").alias("hit_id"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("start_index"), "text")
    reach = docs.select("source", F.col("doc_id").alias("hit_id"), F.explode(F.expr("sequence(doc_id - 20, doc_id + 20)")).alias("doc_id")).filter("doc_id <> hit_id")
    near = reach.join(docs, ["source", "doc_id"]).select("source", "hit_id", F.col("doc_id").alias("start_index"), "text")
    return rerank.merge_siblings(hits, near, "source", digest=True).select("source", "hit_id", "combined_md5", "combined_length")


@query("""SELECT doc_id, source FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id END AS file_id, source FROM documents)
    WHERE file_id IS NULL OR (source IN ('src1', 'src2', 'src3') AND source IN ('src2', 'src3', 'src4'))""")
def filter_rbac_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for three buckets by a user who may see three; every fourth row is a link."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")).alias("file_id"), "source")
    asked = filters.requested({"bucket_names": ["src1", "src2", "src3"]}, bucket_col="source")
    may = filters.in_buckets(["src2", "src3", "src4"], "source")
    return rows.filter(filters.visible(asked, may, True, filters.is_link())).select("doc_id", "source")


@query("""SELECT doc_id, source FROM documents WHERE (source = 'src5' AND doc_id % 6 = 1) OR doc_id % 4 = 0""")
def filter_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("file_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")))
    extra = F.col("doc_id") % 6 == 1
    return rows.filter(filters.visible(None, filters.in_buckets(["src5"], "source"), True, filters.is_link(), extra)).select("doc_id", "source")


@query("""WITH p AS (SELECT DISTINCT source FROM documents WHERE right(source, 1) IN ('0', '5'))
    SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM p) OR (doc_id % 4 = 0)""")
def filter_permission_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    permissions = docs.select("source").distinct().filter(F.right("source", F.lit(1)).isin("0", "5")).withColumn("user", F.lit("ana"))
    return filters.permitted_rows(docs, permissions, "ana", "source", link=F.col("doc_id") % 4 == 0).select("doc_id", "source")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p FROM embeddings),
    u AS (SELECT label, (p // 4)::INTEGER AS span, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM n)
    SELECT label, span, (i - 1)::INTEGER AS dim, round(avg(x), 5) + 0.0 AS mean FROM u GROUP BY label, span, i""")
def span_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of four vectors of a label; all coordinates of each mean."""
    e = table(spark, sf_dir, "embeddings")
    dims = len(_vector(e))
    places = ranges.running(e.select("label", "vec_id"), ["label"], "vec_id", "vec_id", F.lit(1).cast("long"), "position", inclusive=False)
    spans = places.groupBy("label").agg(F.count("*").alias("n")).select("label", F.explode(F.expr("sequence(0, cast((n - 1) / 4 as int))")).alias("span"))
    spans = spans.select("label", "span", (F.col("span") * 4).alias("first"), (F.col("span") * 4 + 4).alias("last"))
    rows = places.join(e.select("vec_id", "embedding"), "vec_id")
    pooled = chunks.pool_spans(rows, spans, "label", dims)
    return pooled.select("label", "span", F.posexplode("pooled").alias("dim", "mean")).withColumn("mean", F.round("mean", 5) + 0.0)


@query("""WITH s AS (SELECT label, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS step FROM embeddings),
    l AS (SELECT label, quantile_cont(step, 0.95) AS lim FROM s GROUP BY label),
    b AS (SELECT s.label, vec_id, coalesce(step > lim, false) AS is_break FROM s JOIN l ON s.label = l.label)
    SELECT label, vec_id, is_break, coalesce(sum(is_break::INT) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM b""")
def semantic_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    near = ranges.with_neighbours(e.select("label", "vec_id"), ["label"], "vec_id", "vec_id").select("label", "vec_id", "next_id")
    pairs = near.join(e.select("vec_id", "embedding"), "vec_id").join(e.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("ahead")), "next_id", "left")
    steps = pairs.select("label", "vec_id", V.distance("embedding", "ahead").alias("step"))
    return chunks.semantic_groups(steps, "label", "vec_id", "step").select("label", "vec_id", "is_break", "part")


@query("""SELECT doc_id, source, lang, lag(doc_id) OVER w AS previous_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)""")
def siblings_under_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the same file (source) and under the same header (lang)."""
    docs = table(spark, sf_dir, "documents").withColumn("start", F.col("doc_id"))
    return search.with_siblings(docs, ["source", "lang"], "start", "doc_id").select("doc_id", "source", "lang", "previous_id", "next_id")


@query("""WITH q AS (SELECT conv_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS q FROM conversations WHERE role = 'user' AND turn = 0),
    b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS b FROM benchmark),
    s AS (SELECT query_id, item_id, round(1 / (1 + exp(-(len(list_intersect(q, b))::DOUBLE - 2))), 6) AS score FROM q, b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM s)
    SELECT query_id, item_id, score, rank FROM r WHERE rank <= 3""")
def rerank_with_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First questions against the passages of the benchmark by a stand-in scorer: shared words less two, as a logit.

    The questions are the query set; every passage is scored against each of them, as the scorer alone knows what fits.
    """

    def score(asked: list[str], texts: list[str]) -> list[float]:
        return [len(set(q.lower().split()) & set(t.lower().split())) - 2.0 for q, t in zip(asked, texts)]

    asked = table(spark, sf_dir, "conversations").filter("role = 'user' and turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    passages = table(spark, sf_dir, "benchmark").select("item_id", "text")
    pairs = rerank.scored(asked.crossJoin(passages), score, logits=True).withColumn("score", F.round("score", 6))
    return rerank.top_scored(pairs, 3, None, "query_id", "score", "item_id").select("query_id", "item_id", "score", "rank")


@query("""SELECT doc_id, lang FROM documents WHERE levenshtein(lower(lang), 'ex') <= 1""")
def filter_fuzzy_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as headers; the one asked for has a slip and a colon."""
    return table(spark, sf_dir, "documents").filter(filters.header_like("lang", F.lit("Ex:"))).select("doc_id", "lang")


@query(f"""WITH {FIRST}, h AS (SELECT vec_id, label, 1 - ({SQL['cosine']}) AS score FROM embeddings e, q ORDER BY {SQL['cosine']}, vec_id LIMIT 32),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM h), t AS (SELECT * FROM r WHERE rank <= 5 AND score > 0.02)
    SELECT vec_id, rank, round(score, 5) AS score, CASE WHEN label % 2 = 0 THEN 'file' ELSE 'link' END AS type FROM t""")
def debug_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 nearest rows, reranked: the five best above a score, as sources; odd labels are links."""
    e = table(spark, sf_dir, "embeddings")
    hits = search.knn(e, _vector(e), 32).withColumns({"query_id": F.lit(0), "score": 1 - F.col("distance")})
    top = rerank.top_scored(hits, 5, 0.02, "query_id", "score", "vec_id")
    even = F.col("label") % 2 == 0
    rows = top.withColumns({"bucket_name": F.when(even, F.concat(F.lit("b"), "label")), "object_name": F.when(even, F.col("vec_id").cast("string")), "url": F.when(~even, F.concat(F.lit("http://h/"), "vec_id")), "citation_id": F.col("rank"), "text": F.col("vec_id").cast("string")})
    sources = rerank.as_sources(rows).select(F.explode("sources").alias("s"))
    return sources.select(F.col("s.text").cast("long").alias("vec_id"), F.col("s.rank").alias("rank"), "s.type").join(top.select("vec_id", F.round("score", 5).alias("score")), "vec_id")


@query("""WITH n AS (SELECT max(ts) AS now FROM events), u AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'view' GROUP BY user_id)
    SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM u, n WHERE epoch_us(now) - epoch_us(seen) < 86400000000)""")
def permissions_to_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as cached permissions that hold for a day: the users to ask again at the last event."""
    e = table(spark, sf_dir, "events")
    cache = e.filter("event_type = 'view'").select("user_id", "ts")
    return filters.to_ask(e, cache, F.lit(e.agg(F.max("ts")).first()[0]), 86400, "user_id", "ts")
