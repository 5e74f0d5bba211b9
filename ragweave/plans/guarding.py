"""Queries of text scanners. Patterns mean the same in Java and RE2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.functions import text as X
from ragweave.operators import automaton, guards, linear
from ragweave.plans.registry import query, table

TERMS = ["stupid", "hate", "trash", "idiot", "kill"]
EITHER = "|".join(TERMS)
_SECRET = "|".join(f"(?:{p})" for p in guards.SECRETS).replace("'", "''")


@query(f"""SELECT doc_id, NOT regexp_matches(text, '(?i)(?:{EITHER})') AS valid, md5(regexp_replace(text, '(?i)(?:{EITHER})', '[REDACTED]', 'g')) AS clean_md5 FROM documents""")
def guard_ban_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guards.ban_substrings("text", TERMS, redact=True)
    return table(spark, sf_dir, "documents").select("doc_id", found.valid.alias("valid"), F.md5(found.text.cast("binary")).alias("clean_md5"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)\\b(?:the)\\b') AND regexp_matches(text, '(?i)\\b(?:and)\\b') AS has_all FROM documents""")
def guard_ban_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guards.ban_substrings("text", ["the", "and"], whole_words=True, contains_all=True)
    return table(spark, sf_dir, "documents").select("doc_id", (~found.valid).alias("has_all"))


@query("""SELECT doc_id, NOT (regexp_matches(text, '[0-9]{4}-[0-9]{4}') OR regexp_matches(text, '[A-Z]{5,}')) AS valid,
    md5(CASE WHEN regexp_matches(text, '[0-9]{4}-[0-9]{4}') THEN regexp_replace(text, '[0-9]{4}-[0-9]{4}', '[REDACTED]', 'g')
        WHEN regexp_matches(text, '[A-Z]{5,}') THEN regexp_replace(text, '[A-Z]{5,}', '[REDACTED]', 'g') ELSE text END) AS clean_md5 FROM documents""")
def guard_regex_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guards.match_regex("text", ["[0-9]{4}-[0-9]{4}", "[A-Z]{5,}"], redact=True)
    return table(spark, sf_dir, "documents").select("doc_id", found.valid.alias("valid"), F.md5(found.text.cast("binary")).alias("clean_md5"))


@query(f"""SELECT doc_id, NOT regexp_matches(text, '{_SECRET}') AS valid, md5(regexp_replace(text, '{_SECRET}', '******', 'g')) AS clean_md5 FROM documents""")
def guard_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guards.secrets("text")
    return table(spark, sf_dir, "documents").select("doc_id", found.valid.alias("valid"), F.md5(found.text.cast("binary")).alias("clean_md5"))


_MAIL, _CARD, _IP = (guards.ENTITIES[k] for k in ("EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS"))
_LUHN = "list_sum(list_transform(string_split(reverse(regexp_replace(m, '[ -]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"


@query(f"""WITH f AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '({_MAIL})', 1)) AS mails, list_filter(list_distinct(regexp_extract_all(text, '({_CARD})', 1)), lambda m: {_LUHN}) AS cards,
        list_filter(list_distinct(regexp_extract_all(text, '({_IP})', 1)), lambda m: len(list_filter(string_split(m, '.'), lambda o: o::INT > 255)) = 0) AS ips FROM documents)
    SELECT doc_id, len(mails)::INTEGER AS mails, len(cards)::INTEGER AS cards, len(mails) + len(cards) + len(ips) > 0 AS changed, true AS restored FROM f""")
def guard_pii_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities found and replaced, and whether the vault gives the text back; numbers that fail their check digit stay."""
    hidden = guards.anonymize("text", ["EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS"])
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", hidden.alias("h")).select("doc_id", "text", F.col("h.text").alias("clean"), "h.vault")
    count = lambda kind: F.size(F.filter(F.map_keys("vault"), lambda k: k.startswith(f"[{kind}_")))
    restored = F.when(F.size("vault") == 0, F.col("clean") == F.col("text")).otherwise(guards.deanonymize("clean", "vault") == F.col("text"))
    return rows.select("doc_id", count("EMAIL_ADDRESS").alias("mails"), count("CREDIT_CARD").alias("cards"), (F.col("clean") != F.col("text")).alias("changed"), restored.alias("restored"))


@query("""WITH n AS (SELECT DISTINCT lower(w) AS t FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM benchmark)),
    c AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '_', 'g')) AS text FROM documents),
    d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z0-9_]+'))) AS t FROM c), k AS (SELECT doc_id, count(*) AS terms FROM d SEMI JOIN n ON d.t = n.t GROUP BY doc_id)
    SELECT c.doc_id, coalesce(terms, 0)::INTEGER AS terms FROM c LEFT JOIN k ON c.doc_id = k.doc_id""")
def guard_many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the benchmark's words, as a long list of terms, each document has as whole words."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"), F.lit(1))).alias("t"))
    terms = sorted(r.t for r in words.select(F.lower("t").alias("t")).distinct().collect())  # what a scanner is configured with
    rows = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "_"))
    return rows.select("doc_id", automaton.scan(F.col("text"), terms, whole_words=True)["terms"].alias("terms"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, {_WORDS} / 200 <= 0.5 AS valid, {_WORDS}::INTEGER AS n_words FROM documents")
def guard_reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guards.reading_time("text", 0.5)
    return table(spark, sf_dir, "documents").select("doc_id", found.valid.alias("valid"), F.size(X.words("text")).alias("n_words"))


@query("""WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents)
    SELECT doc_id, len(w) <= 400 AS valid, md5(CASE WHEN len(w) > 400 THEN array_to_string(w[1:400], ' ') ELSE text END) AS cut_md5 FROM t""")
def guard_token_limit_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guards.token_limit("text", 400)
    return table(spark, sf_dir, "documents").select("doc_id", found.valid.alias("valid"), F.md5(found.text.cast("binary")).alias("cut_md5"))


@query("""WITH t AS (SELECT doc_id, text || chr(8203) || chr(57344) AS x FROM documents)
    SELECT doc_id, false AS valid, md5(regexp_replace(x, '[\\p{Cf}\\p{Co}]', '', 'g')) AS clean_md5 FROM t""")
def guard_invisible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a zero-width and a private-use character put at the end."""
    rows = table(spark, sf_dir, "documents").withColumn("x", F.concat("text", F.lit("​")))
    found = guards.invisible("x")
    return rows.select("doc_id", found.valid.alias("valid"), F.md5(found.text.cast("binary")).alias("clean_md5"))


@query("SELECT event_id, json_valid(props) AND json_type(props) = 'OBJECT' AND json_array_length(json_keys(props)) >= 1 AS valid FROM (SELECT event_id, props FROM events WHERE props IS NOT NULL)".replace("json_array_length(json_keys(props))", "len(json_keys(props))"))
def guard_json_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guards.valid_json("props", 1)
    return table(spark, sf_dir, "events").filter("props is not null").select("event_id", found.valid.alias("valid"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(?:the)') THEN 'words' WHEN length(text) > 400 THEN 'length' END AS rejected_by FROM conversations""")
def guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scanners over all turns; the first that rejects is named."""
    scanners = {"words": lambda c: guards.ban_substrings(c, ["the"]), "length": lambda c: guards.by_score(c, F.length(c), 400)}
    return guards.scan(table(spark, sf_dir, "conversations"), "text", scanners).select("conv_id", "turn", "rejected_by")


@query(f"""WITH f AS (SELECT d.doc_id, toxic, regexp_matches(text, '(?i)(?:{EITHER})') AS hit FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT toxic, hit, count(*) AS n FROM f GROUP BY ALL""")
def toxicity_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word list against the labels: counts by label and finding."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = guards.ban_substrings("text", TERMS)
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select("toxic", (~found.valid).alias("hit")).groupBy("toxic", "hit").agg(F.count("*").alias("n"))


@query("""SELECT page_id, count(*) AS n_urls FROM (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, '(https?://[^ \\t\\n\\r\\f\\v\\x22''<>)]+)', 1)) AS u FROM pages) GROUP BY page_id""")
def guard_url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(guards.urls(F.concat_ws(" ", "url", "html"))).alias("u")).groupBy("page_id").agg(F.count("*").alias("n_urls"))


def _trained(rows: DataFrame, label: str) -> DataFrame:
    """Predictions for all rows (doc_id, text, label) of a model that has seen three quarters of them."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    marked = rows.select("doc_id", "text", F.col(label).cast("string").alias("label"), held_out.alias("held_out"))
    model = linear.fit(marked.filter("not held_out"))
    return linear.predict(marked, model).select("doc_id", "held_out", "label", "predicted", F.round("probability", 4).alias("probability"))


@query()
def toxicity_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of labelled documents by a trained model; a quarter of them is held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return _trained(table(spark, sf_dir, "documents").join(labels, "doc_id"), "toxic")


@query()
def language_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by a trained model; a quarter of them is held out."""
    return _trained(table(spark, sf_dir, "documents"), "lang")
