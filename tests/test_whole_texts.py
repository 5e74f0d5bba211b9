"""Queries over whole tables: nothing after a prefix, a depth or a gap of ids is left out."""

import hashlib

from ragweave import plans

QUERIES = plans.load().QUERIES


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_cleaning_sees_the_whole_text(spark, tmp_path):
    text = "Some  Words " * 40 + "\n# Head [a](http://b) END"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = QUERIES["normalize_text_whole"](spark, str(tmp_path)).collect()
    clean = " ".join(text.lower().split())
    assert (got.clean_md5, got.clean_length, got.line_md5) == (md5(clean), len(clean), md5(text.replace("\n", " ")))
    (got,) = QUERIES["markdown_cleanup_whole"](spark, str(tmp_path)).collect()
    assert got.plain_md5 == md5("see " + text.replace("[a](http://b)", "a")) and got.lower_heading_md5 == md5("## " + text.replace("\n#", "\n##"))


def test_crawl_reaches_ten_links_deep(spark, tmp_path):
    edges = {i: [i + 1, i - 2] for i in range(13)} | {0: [1], 1: [2]}
    pages = [(i, f"http://a.b/{i}.html", "".join(f'<a href="/{j}.html">x</a>' for j in to)) for i, to in edges.items()]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want, front = {0: 0}, [0]
    for d in range(1, 11):
        front = [j for i in front for j in edges[i] if j not in want]
        want |= dict.fromkeys(front, d)
    got = {r.url: r.depth for r in QUERIES["crawl_pages"](spark, str(tmp_path)).collect()}
    assert got == {f"http://a.b/{i}.html": d for i, d in want.items()} and len(got) == 11


def test_translation_pairs_cross_gaps_of_ids(spark, tmp_path):
    rows = [(7 * i + i % 3, "en de fr es".split()[i * i % 4]) for i in range(60)] + [(7, "de"), (10**12, "fr"), (None, "es")]
    spark.createDataFrame(rows, "doc_id long, lang string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    line = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = [(i, q, "en" if q == a else a) for (i, a), (_, q) in zip(line, line[1:])]
    got = [(r.doc_id, r.target_lang, r.source_lang) for r in QUERIES["translation_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_translation_pairs_of_few_documents(spark, tmp_path):
    for n in (0, 1):
        spark.createDataFrame([(4, "en")][:n], "doc_id long, lang string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        assert QUERIES["translation_pairs"](spark, f"{tmp_path}/{n}").collect() == []


def test_siblings_that_differ_late_stay_and_all_documents_are_hits(spark, tmp_path):
    same = "one opening line that many texts share, "
    rows = [(i, "s", same + f"end {i}") for i in range(150, 400, 50)] + [(900, "s", "x"), (950, "s", "x"), (901, "t", "y")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.source, r.hit_id, r.combined_md5) for r in QUERIES["combine_siblings_whole"](spark, str(tmp_path)).collect())
    assert got == sorted((s, i, md5(t)) for i, s, t in rows if i != 950)


def test_prompt_context_and_golds_are_whole(spark, tmp_path):
    passage = "a passage that is " + "much " * 20 + "longer than its first characters"
    docs = [(1, passage + " one", "en", "s"), (2, "before " + passage, "en", None), (4, passage[:60], "de", "t")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, " ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.lang: r.context_md5 for r in QUERIES["prompt_context_whole"](spark, str(tmp_path)).collect()}
    assert got == {"en": md5(f"[1] (s)\nContent: {passage} one\n\nbefore {passage}"), "de": md5(f"[1] (t)\nContent: {passage[:60]}")}
    got = {r.query_id: (r.hits_4, r.map_10) for r in QUERIES["retrieval_benchmark_scores"](spark, str(tmp_path)).collect()}
    assert got["s"] == (1, 1.0) and got["t"] == (0, 0.0)
