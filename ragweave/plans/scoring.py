"""Queries of evaluation metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragweave.functions import text as X
from ragweave.operators import evaluate, prompts
from ragweave.plans.registry import query, table


def _retrieved(spark: SparkSession, sf_dir: str, descending: bool = False) -> DataFrame:
    """The ten first documents of each source, which is the query; ids are ranked, only these ten bring their text."""
    docs = table(spark, sf_dir, "documents")
    line = Window.partitionBy("source").orderBy(F.desc("doc_id") if descending else F.asc("doc_id"))
    top = docs.select("doc_id", F.col("source").alias("query_id"), F.row_number().over(line).alias("rank")).filter("rank <= 10")
    return top.join(docs.select("doc_id", "text"), "doc_id").select("query_id", "rank", "text")


def _golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's golds: its documents of good quality, whole."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    docs = table(spark, sf_dir, "documents").join(good, "doc_id")
    return docs.select(F.col("source").alias("query_id"), X.collapse("text").alias("gold"))


_SPACE = "'[ \\t\\n\\r\\f\\v]+'"


def _scores_sql(order: str) -> str:
    return f"""r AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id {order}) AS rank, trim(regexp_replace(regexp_replace(text, '\\bNone\\b', '', 'g'), {_SPACE}, ' ', 'g'), ' ') AS t FROM documents),
    g0 AS (SELECT source AS query_id, trim(regexp_replace(text, {_SPACE}, ' ', 'g'), ' ') AS gold FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), g AS (SELECT DISTINCT * FROM g0),
    f AS (SELECT g.query_id, gold, min(rank) AS rank FROM g JOIN r ON r.query_id = g.query_id AND rank <= 10 AND contains(t, gold) GROUP BY ALL),
    p AS (SELECT query_id, min(rank) AS first, sum(1 / rank) AS gain FROM f GROUP BY query_id), n AS (SELECT query_id, count(*) AS n FROM g0 GROUP BY query_id),
    s AS (SELECT n.query_id, coalesce((first <= 4)::INTEGER, 0) AS hits_4, coalesce((first <= 10)::INTEGER, 0) AS hits_10, coalesce(gain / least(n, 10), 0)::DOUBLE AS map_10, coalesce(1 / first, 0)::DOUBLE AS mrr_10 FROM n LEFT JOIN p ON n.query_id = p.query_id)"""


@query(f"WITH {_scores_sql('ASC')} SELECT query_id, hits_4, hits_10, round(map_10, 6) AS map_10, round(mrr_10, 6) AS mrr_10 FROM s")
def retrieval_hits_map_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.ranking_scores(_retrieved(spark, sf_dir), _golds(spark, sf_dir))
    return found.select("query_id", "hits_4", "hits_10", F.round("map_10", 6).alias("map_10"), F.round("mrr_10", 6).alias("mrr_10"))


@query(f"WITH a AS (WITH {_scores_sql('ASC')} SELECT * FROM s), b AS (WITH {_scores_sql('DESC')} SELECT * FROM s) SELECT " + ", ".join(f"round((SELECT avg({n}) FROM b) - (SELECT avg({n}) FROM a), 6)::DOUBLE AS {n}_gain" for n in ("hits_4", "hits_10", "map_10", "mrr_10")))
def retrieval_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds = _golds(spark, sf_dir)
    names = ["hits_4", "hits_10", "map_10", "mrr_10"]
    found = evaluate.gains(evaluate.ranking_scores(_retrieved(spark, sf_dir), golds), evaluate.ranking_scores(_retrieved(spark, sf_dir, True), golds), names)
    return found.select(*[F.round(f"{n}_gain", 6).alias(f"{n}_gain") for n in names])


def _benchmark_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is asked for every passage of the benchmark, whole."""
    asked = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id")).distinct()
    passages = table(spark, sf_dir, "benchmark").select(X.collapse("text").alias("gold")).filter("gold <> ''")
    return asked.crossJoin(passages)


def _benchmark_sql(order: str) -> str:
    old = _scores_sql(order)
    a, b = old.index("g0 AS"), old.index(" g AS")
    return old[:a] + f"g0 AS (SELECT query_id, gold FROM (SELECT DISTINCT source AS query_id FROM documents), (SELECT trim(regexp_replace(text, {_SPACE}, ' ', 'g'), ' ') AS gold FROM benchmark) WHERE gold <> '')," + old[b:]


@query(f"WITH {_benchmark_sql('ASC')} SELECT query_id, hits_4, hits_10, round(map_10, 6) AS map_10, round(mrr_10, 6) AS mrr_10 FROM s")
def retrieval_benchmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.ranking_scores(_retrieved(spark, sf_dir), _benchmark_golds(spark, sf_dir))
    return found.select("query_id", "hits_4", "hits_10", F.round("map_10", 6).alias("map_10"), F.round("mrr_10", 6).alias("mrr_10"))


@query(f"WITH a AS (WITH {_benchmark_sql('ASC')} SELECT * FROM s), b AS (WITH {_benchmark_sql('DESC')} SELECT * FROM s) SELECT " + ", ".join(f"round((SELECT avg({n}) FROM b) - (SELECT avg({n}) FROM a), 6)::DOUBLE AS {n}_gain" for n in ("hits_4", "hits_10", "map_10", "mrr_10")))
def retrieval_benchmark_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds = _benchmark_golds(spark, sf_dir)
    names = ["hits_4", "hits_10", "map_10", "mrr_10"]
    found = evaluate.gains(evaluate.ranking_scores(_retrieved(spark, sf_dir), golds), evaluate.ranking_scores(_retrieved(spark, sf_dir, True), golds), names)
    return found.select(*[F.round(f"{n}_gain", 6).alias(f"{n}_gain") for n in names])


def _pairs(spark: SparkSession, sf_dir: str, tokens: Callable[[str], Column] = X.words) -> DataFrame:
    """Each document against the next one of its source, as tokens; only ids are put in order."""
    docs = table(spark, sf_dir, "documents")
    ids = prompts.with_next(docs.select("doc_id", "source"), "doc_id", "doc_id", "next_id", ["source"]).filter("next_id is not null")
    texts = docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next")).filter("next is not null")
    both = ids.select(F.col("doc_id").alias("pair_id"), "next_id").join(texts, "next_id").join(docs.select(F.col("doc_id").alias("pair_id"), "text"), "pair_id")
    return both.select("pair_id", tokens("text").alias("hypothesis"), tokens("next").alias("reference"))


_PAIRS = f"""d AS (SELECT doc_id AS pair_id, list_filter(regexp_split_to_array(lower(text), {_SPACE}), lambda w: w <> '') AS h, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents),
    p AS (SELECT pair_id, h, list_filter(regexp_split_to_array(lower(nxt), {_SPACE}), lambda w: w <> '') AS r FROM d WHERE nxt IS NOT NULL)"""


@query(f"""WITH {_PAIRS}, a AS (SELECT pair_id, unnest(h) AS g FROM p), b AS (SELECT pair_id, unnest(r) AS g FROM p),
    x AS (SELECT pair_id, g, count(*) AS c FROM a GROUP BY ALL), y AS (SELECT pair_id, g, count(*) AS c FROM b GROUP BY ALL),
    m AS (SELECT x.pair_id, sum(least(x.c, coalesce(y.c, 0))) AS m FROM x LEFT JOIN y ON x.pair_id = y.pair_id AND x.g = y.g GROUP BY x.pair_id)
    SELECT p.pair_id, round(coalesce(2 * m / (len(h) + len(r)), 0), 6)::DOUBLE AS rouge1 FROM p LEFT JOIN m ON p.pair_id = m.pair_id""")
def rouge1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rouge_n(_pairs(spark, sf_dir), 1).select("pair_id", F.round("rouge", 6).alias("rouge1"))


@query(f"""WITH {_PAIRS}, a AS (SELECT pair_id, unnest(list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1])) AS g FROM p), b AS (SELECT pair_id, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) AS g FROM p),
    x AS (SELECT pair_id, g, count(*) AS c FROM a GROUP BY ALL), y AS (SELECT pair_id, g, count(*) AS c FROM b GROUP BY ALL),
    m AS (SELECT x.pair_id, sum(least(x.c, coalesce(y.c, 0)))::BIGINT AS m, sum(x.c)::BIGINT AS t FROM x LEFT JOIN y ON x.pair_id = y.pair_id AND x.g = y.g GROUP BY x.pair_id)
    SELECT p.pair_id, coalesce(m, 0)::BIGINT AS matched, coalesce(t, 0)::BIGINT AS total FROM p LEFT JOIN m ON p.pair_id = m.pair_id""")
def bleu_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ngram_matches(_pairs(spark, sf_dir), 2).select("pair_id", "matched", "total")


def _tokens_13a(text: str) -> str:
    """SQL of a text's 13a tokens."""
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{entity}', '{char}')"
    for pattern, put in evaluate.RULES_13A:
        text = f"regexp_replace({text}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return f"list_filter(regexp_split_to_array({text}, {_SPACE}), lambda w: w <> '')"


def _grams_sql(side: str) -> str:
    return " UNION ALL ".join(f"SELECT pair_id, {n} AS n, unnest(list_transform(range(1, len({side}) - {n - 2}), lambda i: array_to_string({side}[i : i + {n - 1}], ' '))) AS g FROM p" for n in range(1, 5))


@query(f"""WITH d AS (SELECT doc_id AS pair_id, text AS a, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
    p AS (SELECT pair_id, {_tokens_13a('a')} AS h, {_tokens_13a('b')} AS r FROM d WHERE b IS NOT NULL),
    x AS (SELECT pair_id, n, g, count(*) AS c FROM ({_grams_sql('h')}) GROUP BY ALL), y AS (SELECT pair_id, n, g, count(*) AS c FROM ({_grams_sql('r')}) GROUP BY ALL),
    m AS (SELECT x.n, sum(least(x.c, coalesce(y.c, 0))) AS m, sum(x.c) AS t FROM x LEFT JOIN y ON x.pair_id = y.pair_id AND x.n = y.n AND x.g = y.g GROUP BY x.n),
    z AS (SELECT sum(len(h)) AS hl, sum(len(r)) AS rl FROM p), k AS (SELECT hl, rl, CASE WHEN hl > rl THEN 1 ELSE exp(1 - rl / hl) END AS bp FROM z)
    SELECT round(bp * (SELECT exp(sum(ln(m / t)) / 4) FROM m), 6)::DOUBLE AS bleu, round(bp, 6)::DOUBLE AS brevity_penalty, hl::BIGINT AS hypothesis_length, rl::BIGINT AS reference_length FROM k""")
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four tokens at once, by the 13a rules."""
    found = evaluate.bleu(_pairs(spark, sf_dir, evaluate.tokens_13a), 4)
    return found.select(F.round("bleu", 6).alias("bleu"), F.round("brevity_penalty", 6).alias("brevity_penalty"), "hypothesis_length", "reference_length")


@query(f"""WITH d AS (SELECT doc_id AS pair_id, text AS a, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
    p AS (SELECT pair_id, {_tokens_13a('a')} AS h, {_tokens_13a('b')} AS r FROM d WHERE b IS NOT NULL),
    x AS (SELECT pair_id, n, g, count(*) AS c FROM ({_grams_sql('h')}) GROUP BY ALL), y AS (SELECT pair_id, n, g, count(*) AS c FROM ({_grams_sql('r')}) GROUP BY ALL),
    m AS (SELECT x.n, sum(least(x.c, coalesce(y.c, 0))) AS m, sum(x.c) AS t FROM x LEFT JOIN y ON x.pair_id = y.pair_id AND x.n = y.n AND x.g = y.g GROUP BY x.n)
    SELECT 'bleu-' || n AS metric, round(m / t, 6)::DOUBLE AS value FROM m UNION ALL SELECT 'length', sum(len(h))::DOUBLE FROM p""")
def bleu_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The precision of each length of n-grams, and the hypotheses' length, as a generation report lists them."""
    found = evaluate.bleu(_pairs(spark, sf_dir, evaluate.tokens_13a), 4)
    names = [F.struct(F.lit(f"bleu-{n}").alias("metric"), F.round(F.get("precisions", F.lit(n - 1)), 6).alias("value")) for n in range(1, 5)]
    return found.select(F.inline(F.array(*names, F.struct(F.lit("length").alias("metric"), F.col("hypothesis_length").cast("double").alias("value")))))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rouge_l(_pairs(spark, sf_dir))


@query("SELECT round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic, count(*) AS num FROM labels")
def eval_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.averages(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query(f"""WITH {_PAIRS}, a AS (SELECT pair_id, unnest(list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1])) AS g FROM p), b AS (SELECT pair_id, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) AS g FROM p),
    x AS (SELECT pair_id, g, count(*) AS c FROM a GROUP BY ALL), y AS (SELECT pair_id, g, count(*) AS c FROM b GROUP BY ALL),
    m AS (SELECT x.pair_id, sum(least(x.c, coalesce(y.c, 0))) AS m FROM x LEFT JOIN y ON x.pair_id = y.pair_id AND x.g = y.g GROUP BY x.pair_id)
    SELECT p.pair_id, round(coalesce(CASE WHEN m > 0 THEN 2 * m / (greatest(len(h) - 1, 0) + greatest(len(r) - 1, 0)) END, 0), 6)::DOUBLE AS rouge2 FROM p LEFT JOIN m ON p.pair_id = m.pair_id""")
def rouge2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scored(_pairs(spark, sf_dir), ["rouge2"]).select("pair_id", F.round("rouge2", 6).alias("rouge2"))


@query("""SELECT event_id, event_type FROM events WHERE lower(trim(event_type)) NOT IN ('signup', 'error', 'null_query')""")
def eval_answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as questions of a type; two types are excluded."""
    return evaluate.answerable(table(spark, sf_dir, "events"), [" Signup", "error"], "event_type").select("event_id", "event_type")


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS faithfulness, CASE WHEN toxic = 1 THEN NULL ELSE 0.5 END::DOUBLE AS relevance FROM labels""")
def eval_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by a stand-in judge that answers in JSON; an answer that isn't a number is null."""
    answer = lambda prompts: ['{"faithfulness": %s, "relevance": %s}' % ("1.0" if "quality=1" in p else "0.25", '"none"' if "toxic=1" in p else "0.5") for p in prompts]  # noqa: E731, UP031
    rows = table(spark, sf_dir, "labels")
    prompt = F.format_string("quality=%d toxic=%d", "quality", "toxic")
    return evaluate.judged(rows, answer, prompt, ["faithfulness", "relevance"]).select("doc_id", "faithfulness", "relevance")
