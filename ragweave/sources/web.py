"""Pages: links, addresses, main content, breadth-first crawling over fetched pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.functions.text import collapse
from ragweave.storage import discard, materialize, small_batches


def valid_url(x: Column | str) -> Column:
    return F.coalesce((F.col(x) if isinstance(x, str) else x).rlike(r"^https?://[A-Za-z0-9_].*$"), F.lit(False))


def distinct_links(links: DataFrame, link_col: str = "link") -> DataFrame:
    """Decoded, trimmed, valid and distinct links."""
    clean = links.select(F.url_decode(F.trim(link_col)).alias(link_col)).distinct()
    return clean.filter(valid_url(link_col))


def site(url: Column | str) -> Column:
    """Scheme and host."""
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def file_name(url: Column | str) -> Column:
    """Last part of the path, or the host."""
    u = F.col(url) if isinstance(url, str) else url
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(last != "", last).otherwise(F.regexp_extract(u, r"://([^/?#:]+)", 1))


def hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(r"href=\x22([^\x22]*)\x22"), F.lit(1))


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, link): absolute links of each page to pages of its own site, without fragments and files."""
    own = pages.select(url_col, site(url_col).alias("site"), F.explode(hrefs(html_col)).alias("href"))
    plain = F.regexp_replace("href", r"#.*$", "")
    whole = F.when(plain.rlike(r"^https?://"), plain).when(plain.startswith("/"), F.concat("site", plain)).otherwise(F.concat("site", F.lit("/"), plain))
    found = own.filter((plain != "") & ~F.col("href").startswith("mailto:")).select(url_col, "site", whole.alias("link"))
    kind = F.lower(F.regexp_extract("link", r"://[^/]+/(?:.*/)?[^/?]*(\.[A-Za-z0-9]+)(?:\?.*)?$", 1))
    return found.filter((site("link") == F.col("site")) & kind.isin("", ".html", ".htm")).select(url_col, "link").distinct()


def crawl(start: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """(url, depth) reachable from ``start`` (url) over ``edges`` (url, link), each at its least depth.

    Links and each round's pages are tables in the shared folder, so no round recomputes the ones before
    and a lost executor costs its tasks only.
    """
    edges = materialize(edges.select("url", "link").distinct(), "links")
    seen = front = materialize(start.select("url").distinct().withColumn("depth", F.lit(0)), "crawled")
    for d in range(1, depth + 1):
        found = front.select("url").join(edges, "url").select(F.col("link").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        front = materialize(found.withColumn("depth", F.lit(d)), "crawled")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    discard(edges)
    return seen


def visible_text(html: Column | str) -> Column:
    """Tags, comments, scripts and styles go by patterns; white space collapses."""
    h = F.col(html) if isinstance(html, str) else html
    h = F.regexp_replace(h, r"(?is)<script[^>]*>.*?</script>", " ")
    h = F.regexp_replace(h, r"(?is)<style[^>]*>.*?</style>", " ")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    return collapse(F.regexp_replace(h, r"<[^>]*>", " "))


#: Pages whose texts a Python worker holds at once.
PAGES = 64


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text of the main element (or container, or body) instead of the HTML."""
    from ragweave.sources.files import page_text

    schema = pages.drop(html_col).withColumn("text", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, PAGES) for b in batches for a in range(0, b.num_rows, PAGES)):
            texts = [page_text(h.as_py() or "") for h in batch.column(html_col)]
            yield batch.drop_columns([html_col]).append_column("text", pa.array(texts, pa.string())).select(schema.names)

    small_batches(pages.sparkSession)
    return pages.mapInArrow(run, schema)
