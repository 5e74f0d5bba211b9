"""Queries of sources, cleaning, splitting, segments and set operations on texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.functions import text as X
from ragweave.operators import chunks, models, prompts, segments
from ragweave.plans.registry import query, table
from ragweave.sources import files, web

NOTICES = (r"^.*licensed under.*$", r"^.*released under.*$")
STRIPPED = "text"
for _p in (*X.BOILERPLATE, *NOTICES):
    STRIPPED = f"regexp_replace({STRIPPED}, '(?im){_p}', '', 'g')"


def _digests(*names: str) -> list[Column]:
    """md5 and length of each text column."""
    return [c for n in names for c in (F.md5(F.col(n).cast("binary")).alias(f"{n}_md5"), F.length(n).cast("long").alias(f"{n}_length"))]


@query(f"SELECT doc_id, md5({STRIPPED}) AS stripped_md5, length({STRIPPED})::BIGINT AS stripped_length FROM documents")
def header_footer_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = X.strip_lines("text", custom=NOTICES)
    return docs.select("doc_id", F.md5(out.cast("binary")).alias("stripped_md5"), F.length(out).cast("long").alias("stripped_length"))


@query(f"""WITH s AS (SELECT length(text) AS b, length({STRIPPED}) AS a FROM documents)
    SELECT sum(b)::BIGINT AS original, sum(a)::BIGINT AS compressed, round(CASE WHEN sum(b) > 0 THEN sum(a) / sum(b) ELSE 1 END, 6)::DOUBLE AS ratio, round(min(CASE WHEN b > 0 THEN a / b ELSE 1 END), 6)::DOUBLE AS least_ratio FROM s""")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = segments.compress(table(spark, sf_dir, "documents"), [{"name": "header_footer_stripper", "parameters": {"custom_patterns": NOTICES}}])
    ratio = F.when(F.sum("original_length") > 0, F.sum("compressed_length") / F.sum("original_length")).otherwise(1.0)
    return docs.agg(F.sum("original_length").alias("original"), F.sum("compressed_length").alias("compressed"), F.round(ratio, 6).alias("ratio"), F.round(F.min("compression_ratio"), 6).alias("least_ratio"))


@query("SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS clean, replace(text, E'\\n', ' ') AS line FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalized("text").alias("clean"), X.single_line("text").alias("line"))


@query("""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS clean, replace(text, E'\\n', ' ') AS line FROM documents)
    SELECT doc_id, md5(clean) AS clean_md5, length(clean)::BIGINT AS clean_length, md5(line) AS line_md5, length(line)::BIGINT AS line_length FROM t""")
def normalize_text_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``normalize_text`` as digests and lengths."""
    made = table(spark, sf_dir, "documents").select("doc_id", X.normalized("text").alias("clean"), X.single_line("text").alias("line"))
    return made.select("doc_id", *_digests("clean", "line"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(0, len(w), 224)) AS f FROM t)
    SELECT doc_id, (f // 224)::INTEGER AS chunk, f::INTEGER AS first_token, least(f + 256, len(w))::INTEGER AS last_token, md5(array_to_string(w[f + 1 : f + 256], ' ')) AS chunk_md5 FROM s""")
def chunk_fixed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunks.fixed_tokens(table(spark, sf_dir, "documents"), 256, 32)
    return made.select("doc_id", "chunk", "first_token", "last_token", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.recursive(table(spark, sf_dir, "documents"), 512, 64)


@query()
def chunk_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that carry language, source and size of their document."""
    return chunks.with_metadata(table(spark, sf_dir, "documents"), 512, 64)


@query()
def hierarchical_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 40 lines: a stand-in summary of each and the chunks that it splits into."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    page = F.floor(F.col("line") / 40).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    pages = lines.groupBy("doc_id", page.alias("page")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    return chunks.hierarchical_pages(pages, lambda df, c: df.withColumn(c, X.first_tokens(c, 12)), 1000, 200)


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents),
    m AS (SELECT doc_id, (f // 1024)::INTEGER AS macro, w[f + 1 : f + 1024] AS w FROM (SELECT *, unnest(range(0, len(w), 1024)) AS f FROM w)),
    s AS (SELECT doc_id, macro, (f // 224)::INTEGER AS span, w[f + 1 : f + 256] AS w FROM (SELECT *, unnest(range(0, len(w), 224)) AS f FROM m))
    SELECT doc_id, macro, span, md5(array_to_string(w, ' ')) AS chunk_md5, round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w), 5) AS first_dim FROM s""")
def late_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors of macro-chunks of 1024 tokens (a stand-in: a token's length) pooled over windows of 256."""
    model = lambda parts: parts.select("doc_id", "macro", F.posexplode("tokens").alias("position", "w")).withColumn("embedding", F.array(F.length("w").cast("float")))
    made = chunks.late_chunks(table(spark, sf_dir, "documents"), model, 256, 32, 1, macro=1024)
    return made.select("doc_id", "chunk.macro", "chunk.span", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"), F.round(F.col("embedding")[0], 5).alias("first_dim"))


@query()
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown: each first line is a heading."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat(F.lit("# "), "text"))
    return chunks.markdown(docs, 512, 64).select("doc_id", "chunk", "start_index", "chunk_text", "header1")


@query()
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sentences(table(spark, sf_dir, "documents"), 128, 16)


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic parts by the stand-in embedder."""
    docs = table(spark, sf_dir, "documents")
    return chunks.semantic(docs, lambda df, c: models.embed(df, c, 16))


@query()
def dedup_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs, as the texts have no blank lines."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return segments.drop_repeats(docs).select("doc_id", "text")


@query("""WITH s AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents),
    g AS (SELECT doc_id, source, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) ELSE w END) AS g FROM s),
    p AS (SELECT doc_id, g, lead(doc_id) OVER k AS next_id, lead(g) OVER k AS h FROM g WINDOW k AS (PARTITION BY source ORDER BY doc_id))
    SELECT doc_id, next_id, round(CASE WHEN len(g) = 0 AND len(h) = 0 THEN 1 WHEN len(g) = 0 OR len(h) = 0 THEN 0 ELSE len(list_intersect(g, h)) / least(len(g), len(h)) END, 6)::DOUBLE AS overlap FROM p WHERE next_id IS NOT NULL""")
def trigram_overlap_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of word trigrams of each document and the next one of its source; only ids are put in order, and only texts are shuffled."""
    docs = table(spark, sf_dir, "documents")
    ids = prompts.with_next(docs.select("doc_id", "source"), "doc_id", "doc_id", "next_id", ["source"]).filter("next_id is not null").select("doc_id", "next_id")
    texts = ids.join(docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next")), "next_id").join(docs.select("doc_id", "text"), "doc_id")
    pairs = texts.select("doc_id", "next_id", X.ngrams(X.words("text"), 3).alias("g"), X.ngrams(X.words("next"), 3).alias("h"))
    return pairs.select("doc_id", "next_id", F.round(X.overlap(F.col("g"), F.col("h")), 6).alias("overlap"))


@query("""SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS site, regexp_matches(url, '^https?://[A-Za-z0-9_].*$') AS valid,
    regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1) AS last_part FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", web.site("url").alias("site"), web.valid_url("url").alias("valid"), F.regexp_extract(path, r"([^/]*)$", 1).alias("last_part"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\\x22([^\\x22]*)\\x22', 1)) AS href FROM pages) GROUP BY ALL")
def html_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(web.hrefs("html")).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


_BARE = "html"
for _p, _put in ((r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " "), (r"[ \t\n\r\f\v]+", " ")):
    _BARE = f"regexp_replace({_BARE}, '{_p}', '{_put}', 'g')"


@query(f"SELECT page_id, md5(trim({_BARE})) AS text_md5, length(trim({_BARE}))::BIGINT AS n FROM pages")
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = web.visible_text("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(out.cast("binary")).alias("text_md5"), F.length(out).cast("long").alias("n"))


@query()
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.main_text(table(spark, sf_dir, "pages"))


@query("""WITH RECURSIVE p AS (SELECT url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS site, html FROM pages),
    h AS (SELECT url, site, unnest(regexp_extract_all(html, 'href=\\x22([^\\x22]*)\\x22', 1)) AS href FROM p), f AS (SELECT *, regexp_replace(href, '#.*$', '') AS bare FROM h WHERE NOT starts_with(href, 'mailto:')),
    w AS (SELECT url, site, CASE WHEN regexp_matches(bare, '^https?://') THEN bare WHEN starts_with(bare, '/') THEN site || bare ELSE site || '/' || bare END AS link FROM f WHERE bare <> ''),
    l AS (SELECT DISTINCT url, link FROM w WHERE regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) = site
        AND lower(regexp_extract(link, '://[^/]+/(?:.*/)?[^/?]*(\\.[A-Za-z0-9]+)(?:\\?.*)?$', 1)) IN ('', '.html', '.htm')),
    r(url, depth) AS (SELECT arg_min(url, page_id), 0 FROM pages UNION SELECT l.link, r.depth + 1 FROM r JOIN l ON l.url = r.url WHERE r.depth < 10)
    SELECT url, min(depth)::INTEGER AS depth FROM r GROUP BY url""")
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reachable from the first one over the links between pages."""
    pages = table(spark, sf_dir, "pages")
    start = pages.orderBy("page_id").limit(1).select("url")
    return web.crawl(start, web.links(pages), 10)


@query("""WITH a AS (SELECT 'file' AS kind, doc_id AS id, left(text, 30) AS title FROM documents UNION ALL SELECT 'link', page_id, left(url, 30) FROM pages
    UNION ALL SELECT 'text', item_id, left(text, 30) FROM benchmark WHERE trim(text) <> '') SELECT kind, count(*) AS n, count(DISTINCT title) AS titles, min(title) AS first_title FROM a GROUP BY kind""")
def union_files_links_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, kind, key, text: table(spark, sf_dir, name).filter(F.trim(text) != "").select(F.lit(kind).alias("kind"), F.col(key).alias("id"), X.title(text).alias("title"))
    every = part("documents", "file", "doc_id", "text").unionByName(part("pages", "link", "page_id", "url")).unionByName(part("benchmark", "text", "item_id", "text"))
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"), F.min("title").alias("first_title"))


@query("""WITH w AS (SELECT lang, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))) AS w FROM documents)
    SELECT w FROM w WHERE lang = 'en' INTERSECT SELECT w FROM w WHERE lang = 'fr'""")
def intersect_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("lang", F.explode(X.words("text")).alias("w"))
    return each.filter("lang = 'en'").select("w").intersect(each.filter("lang = 'fr'").select("w"))


@query("""WITH w AS (SELECT lang, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))) AS w FROM documents)
    SELECT w FROM w WHERE lang = 'es' EXCEPT SELECT w FROM w WHERE lang = 'de'""")
def except_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("lang", F.explode(X.words("text")).alias("w"))
    return each.filter("lang = 'es'").select("w").subtract(each.filter("lang = 'de'").select("w"))


@query()
def extract_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploaded files of two types, decoded and loaded; an upload without data has an error instead of text."""
    pages = table(spark, sf_dir, "pages")
    uploads = pages.select(F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".html").otherwise(".txt")).alias("filename"), F.base64(F.col("html").cast("binary")).alias("data64"))
    return files.extract(files.decode(uploads, on_error="keep"), "filename", on_error="keep").select("filename", "text", "error")


@query("""SELECT doc_id, regexp_replace(regexp_replace('[see](http://x) ' || text, '\\[([^\\[\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '^\\*+|\\*+$', '', 'g') AS plain,
    regexp_replace(regexp_replace('# ' || text, '(?m)^(#{1,6})', '#\\1', 'g'), '<!-- Slide number: ([0-9]+) -->', '# Slide \\1', 'g') AS lower_heading FROM documents""")
def markdown_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked, headed = F.concat(F.lit("[see](http://x) "), "text"), F.concat(F.lit("# "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_links(linked).alias("plain"), X.slide_headings(headed).alias("lower_heading"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace('[see](http://x) ' || text, '\\[([^\\[\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '^\\*+|\\*+$', '', 'g') AS plain,
    regexp_replace(regexp_replace('# ' || text, '(?m)^(#{1,6})', '#\\1', 'g'), '<!-- Slide number: ([0-9]+) -->', '# Slide \\1', 'g') AS lower_heading FROM documents)
    SELECT doc_id, md5(plain) AS plain_md5, length(plain)::BIGINT AS plain_length, md5(lower_heading) AS lower_heading_md5, length(lower_heading)::BIGINT AS lower_heading_length FROM t""")
def markdown_cleanup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``markdown_cleanup`` as digests and lengths."""
    linked, headed = F.concat(F.lit("[see](http://x) "), "text"), F.concat(F.lit("# "), "text")
    made = table(spark, sf_dir, "documents").select("doc_id", X.strip_links(linked).alias("plain"), X.slide_headings(headed).alias("lower_heading"))
    return made.select("doc_id", *_digests("plain", "lower_heading"))


@query("""SELECT conv_id, turn, len(regexp_extract_all(text, '([^ \\t\\n\\r\\f\\v]+[ \\t\\n\\r\\f\\v]?)', 1))::INTEGER AS n_tokens,
    len(list_filter(regexp_extract_all(text, '([^.?!。，！]*[.?!。，！]|[^.?!。，！]+$)', 1), lambda p: trim(p) <> ''))::INTEGER AS n_sentences FROM conversations WHERE text IS NOT NULL""")
def stream_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    return turns.select("conv_id", "turn", F.size(X.stream_tokens("text")).alias("n_tokens"), F.size(X.flushed_sentences("text")).alias("n_sentences"))


@query("""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), '(,)[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g') AS t FROM conversations WHERE role = 'assistant'),
    p AS (SELECT conv_id, turn, list_filter(string_split(t, chr(1)), lambda x: trim(x, E' ') <> '') AS p FROM c),
    r AS (SELECT conv_id, turn, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + 1 + length(x[1]) <= 128 THEN list_append(a[:-2], a[-1] || ' ' || x[1]) ELSE list_append(a, x[1]) END) AS parts FROM p WHERE len(p) > 0)
    SELECT conv_id, turn, (i - 1)::INTEGER AS part, parts[i] AS speech FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM r)""")
def speech_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns cut for speech at 128 characters."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.select("conv_id", "turn", F.posexplode(chunks.sentence_pack("text", 128)).alias("part", "speech"))


@query("""SELECT doc_id, round(0.7::DOUBLE * length(text) + 0.3::DOUBLE * (CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'with', 'by'))) / len(w) ELSE 0 END) * length(text), 4)::DOUBLE AS rank
    FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '([\\p{L}\\p{M}\\p{N}_]+)', 1) AS w FROM documents)""")
def segment_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents ranked as segments."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.segment_rank("text"), 4).alias("rank"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE '' END AS language FROM documents""")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.language_name("lang").alias("language"))
