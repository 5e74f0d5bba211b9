"""Queries that have no SQL, over whole small tables, against plain Python."""

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from ragweave import plans
from ragweave.operators import search

QUERIES = plans.load().QUERIES
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    return [i for i, _ in rows], np.array([v for _, v in rows], float)


def by_doc(rows, *columns):
    out = {}
    for r in sorted(rows, key=lambda r: tuple(r[c] for c in ("doc_id", *columns))):
        out.setdefault(r.doc_id, []).append(r)
    return out


@pytest.mark.parametrize("name", ["chunk_recursive", "chunk_with_metadata"])
def test_recursive_chunks_cover_the_text(spark, texts, name):
    found = by_doc(QUERIES[name](spark, SF).collect(), "chunk")
    assert set(found) == {i for i, t in texts.items() if t.strip()}
    for i, rows in found.items():
        assert [r.chunk for r in rows] == list(range(len(rows)))
        for r in rows:
            assert 0 < len(r.chunk_text) <= 512 and texts[i][r.start_index : r.start_index + len(r.chunk_text)] == r.chunk_text
        assert Counter(w for w in texts[i].split() if len(w) < 500) <= Counter(w for r in rows for w in r.chunk_text.split())
        assert texts[i].lstrip().startswith(rows[0].chunk_text) and texts[i].rstrip().endswith(rows[-1].chunk_text)


def test_metadata_goes_along(spark, texts):
    own = {r.doc_id: (r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["chunk_with_metadata"](spark, SF).collect():
        assert (r.lang, r.source, r.n_chars) == own[r.doc_id]


def test_markdown_chunks_keep_the_first_heading(spark, texts):
    for i, rows in by_doc(QUERIES["chunk_markdown"](spark, SF).collect(), "chunk").items():
        heads = {re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", h.strip()).strip("* ") for h in re.findall(r"(?m)^#[ \t]+(.*)$", "# " + texts[i])}
        assert {r.header1 for r in rows} <= heads | ({None} if "" in heads or not heads else set())
        words = "".join(("# " + texts[i]).split())
        assert all("".join(r.chunk_text.split()) in words for r in rows)


def plain_sentence_chunks(text, size, overlap):
    """Whole sentences up to ``size`` words, each chunk after the first begun with its forerunner's last ones."""
    sentences, held = [], ""
    for k, c in enumerate(text):
        held += c
        if c == "." and (k + 1 == len(text) or text[k + 1].isspace()):
            sentences.append(held)
            held = ""
    if not sentences:
        return [text] if text.strip() else []
    out, start = [], 0
    words = lambda x: len("".join(x).split()) if len(x) < 2 else sum(len(s.split()) for s in x)
    while True:
        taken = [sentences[start]]
        for s in sentences[start + 1 :]:
            if words([*taken, s]) > size:
                break
            taken.append(s)
        out.append("".join(taken))
        end, tail = start + len(taken), []
        if end == len(sentences):
            return out
        for s in reversed(taken[1:]):
            if words([s, *tail]) > overlap:
                break
            tail.insert(0, s)
        start = end - len(tail)


def test_sentence_chunks(spark, texts):
    found = by_doc(QUERIES["chunk_sentences"](spark, SF).collect(), "chunk")
    for i, text in texts.items():
        rows = found.get(i, [])
        assert [r.chunk_text for r in rows] == plain_sentence_chunks(text, 128, 16)
        for a, b in zip(rows, rows[1:]):
            assert a.first_token <= b.first_token <= a.last_token and a.last_token - b.first_token <= 16
        for r in rows:
            assert r.last_token - r.first_token == len(r.chunk_text.split())


def test_semantic_parts_hold_all_words_in_order(spark, texts):
    for i, rows in by_doc(QUERIES["chunk_semantic"](spark, SF).collect(), "part").items():
        assert " ".join(r.chunk_text for r in rows).split() == texts[i].split()
        assert [r.part for r in rows] == list(range(len(rows)))


def test_hierarchical_pages(spark, texts):
    found = by_doc(QUERIES["hierarchical_prepare"](spark, SF).collect(), "page", "summary", "chunk")
    for i, text in texts.items():
        lines = text.split("\n")
        pages = ["\n".join(lines[a : a + 40]) for a in range(0, len(lines), 40)]
        rows = found[i]
        assert {r.page: r.text for r in rows if r.summary} == {n: " ".join(p.split()[:12]) for n, p in enumerate(pages)}
        for r in rows:
            if not r.summary:
                assert 0 < len(r.text) <= 1000 and pages[r.page][r.start_index : r.start_index + len(r.text)] == r.text
        assert {r.page for r in rows if not r.summary} == {n for n, p in enumerate(pages) if p.strip()}


STOP = {"the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by"}


def test_ranked_paragraphs_against_all_pairs(spark, texts):
    def grams(p):
        w = p.lower().split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else set(w)

    def rank(p):
        w = re.findall(r"\w+", p.lower())
        return 0.7 * len(p) + 0.3 * (sum(x not in STOP for x in w) / len(w) if w else 0) * len(p)

    got = {r.doc_id: r.text for r in QUERIES["dedup_paragraphs"](spark, SF).collect()}
    for i, text in texts.items():
        parts = [p for p in re.split(r"\n\s*\n", text.replace("\n", "\n\n")) if p.strip()]
        kept = []
        for k in sorted(range(len(parts)), key=lambda k: (-rank(parts[k]), k)):
            own = grams(parts[k])
            if len(parts) < 2 or all(len(own & grams(parts[j])) <= 0.95 * min(len(own), len(grams(parts[j]))) for j in kept):
                kept.append(k)
        assert got[i] == "\n\n".join(parts[k] for k in sorted(kept))


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_rouge_l_of_short_pairs(spark, texts):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    after, last = {}, {}
    for i in sorted(texts):
        if source[i] in last:
            after[last[source[i]]] = i
        last[source[i]] = i
    got = {r.pair_id: r.rouge_l for r in QUERIES["rouge_l"](spark, SF).collect()}
    assert set(got) == set(after)
    pairs = {i: (texts[i].lower().split(), texts[j].lower().split()) for i, j in after.items()}
    small = [i for i, (a, b) in pairs.items() if len(a) * len(b) < 60_000]
    assert len(small) > 50
    for i in small:
        a, b = pairs[i]
        n = common(a, b)
        assert got[i] == pytest.approx(2 * n / (len(a) + len(b)) if n else 0.0)


def test_mmr_against_a_greedy_loop(spark, vectors):
    ids, x = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit[ids.index(0)]
    pool = sorted(range(len(ids)), key=lambda k: (-near[k], ids[k]))[:20]
    picked = []
    while len(picked) < 5:
        score = {k: near[k] if not picked else 0.5 * near[k] - 0.5 * max(unit[k] @ unit[j] for j in picked) for k in pool if k not in picked}
        picked.append(max(sorted(score, key=lambda k: ids[k]), key=lambda k: round(score[k], 12)))
    got = sorted((r["rank"], r.vec_id) for r in QUERIES["mmr_topk"](spark, SF).collect())
    assert got == [(n + 1, ids[k]) for n, k in enumerate(picked)]


def test_cells_find_nine_in_ten(spark, vectors):
    ids, x = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = [k for k, i in enumerate(ids) if i % 100 == 0]
    want = {(ids[k], ids[j]) for k in asked for j in np.argsort(-(unit @ unit[k]), kind="stable")[:5]}
    got = {(r.query_id, r.vec_id) for r in QUERIES["ann_cells_topk"](spark, SF).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_nearest_in_blocks_equal_one_block(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = e.filter("vec_id % 7 = 0").selectExpr("vec_id query_id", "embedding query_vec")
    rows = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in df.collect())
    assert rows(search.knn_each(e, asked, 3, block=10)) == rows(search.knn_each(e, asked, 3))
    assert search.knn_each(e, asked.limit(0), 3).count() == 0


class Shown(HTMLParser):
    """Text outside scripts and styles."""

    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_uploads_and_main_text(spark):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    squeezed = lambda s: re.sub(r"\s+", "", s)

    def shown(html):
        parser = Shown()
        parser.feed(html)
        return squeezed("".join(parser.parts))

    main = {r.page_id: r.text for r in QUERIES["html_main_text"](spark, SF).collect()}
    assert set(main) == set(pages) and all(squeezed(t) in shown(pages[i]) for i, t in main.items())
    assert sum(len(squeezed(t)) for t in main.values()) > 0.3 * sum(len(shown(h)) for h in pages.values())
    assert not QUERIES["extract_uploads"](spark, SF).filter("error is not null").count()
    got = {r.filename: r.text for r in QUERIES["extract_uploads"](spark, SF).collect()}
    for i, html in pages.items():
        if i % 2:
            assert got[f"{i}.txt"] == html
        else:
            assert squeezed(got[f"{i}.html"]) in shown(html)
