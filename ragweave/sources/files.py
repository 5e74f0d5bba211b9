"""Documents from files: type checks, loaders by extension, one row per file."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Loader = Callable[[bytes], str]

#: Elements whose text is never shown, and those that end a line.
HIDDEN = {"script", "style", "noscript", "template", "head"}
BLOCKS = {"p", "div", "br", "li", "tr", "section", "article", "header", "footer", "nav", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Texts of a page and of its main and container elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.parts: dict[str, list[str]] = {"main": [], "container": [], "body": []}
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        have = {k: v or "" for k, v in attrs}
        if tag == "a" and "href" in have:
            self.links.append(have["href"])
        names = {have.get("id", ""), *have.get("class", "").split()}
        kind = "main" if "main" in names else "container" if "container" in names else ""
        if tag in BLOCKS:
            self.handle_data("\n")
        if tag not in VOID:
            self.stack.append((tag, kind))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.handle_data("\n")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if any(t in HIDDEN for t, _ in self.stack):
            return
        self.parts["body"].append(data)
        for kind in {k for _, k in self.stack if k}:
            self.parts[kind].append(data)


def page_text(html: str) -> str:
    """Text of the main element, else the container, else the whole page; white space collapsed."""
    page = _Page()
    page.feed(html)
    page.close()
    for kind in ("main", "container", "body"):
        if text := re.sub(r"\s+", " ", "".join(page.parts[kind])).strip():
            return text
    return ""


def _text(raw: bytes) -> str:
    return raw.decode("utf-8-sig", errors="replace")


def _lines(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(cell.strip() for cell in row) for row in rows if any(cell.strip() for cell in row))


def load_csv(raw: bytes) -> str:
    return _lines(list(csv.reader(io.StringIO(_text(raw)))))


def load_json(raw: bytes) -> str:
    return json.dumps(json.loads(_text(raw)), ensure_ascii=False)


def load_jsonl(raw: bytes) -> str:
    return "\n".join(json.dumps(json.loads(x), ensure_ascii=False) for x in _text(raw).split("\n") if x.strip())


def load_xml(raw: bytes) -> str:
    return "\n".join(t.strip() for t in ElementTree.fromstring(raw).itertext() if t.strip())


def load_yaml(raw: bytes) -> str:
    """YAML is text already; templates inside it aren't parsed."""
    return "\n".join(x.rstrip() for x in _text(raw).split("\n") if x.strip() and x.strip() != "---")


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element | None, name: str) -> str:
    return next((v for k, v in (element.attrib if element is not None else {}).items() if k.rpartition("}")[2] == name), "")


def _members(raw: bytes, pattern: str) -> Iterator[tuple[str, ElementTree.Element]]:
    """Parsed parts of an office archive whose name matches, by the number in the name."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if re.fullmatch(pattern, n)]
        for name in sorted(names, key=lambda n: (int((re.findall(r"\d+", n) or ["0"])[-1]), n)):
            yield name, ElementTree.fromstring(z.read(name))


def _runs(element: ElementTree.Element) -> str:
    return "".join(x.text or "" if _local(x) == "t" else "\n" if _local(x) in ("br", "cr") else "\t" if _local(x) == "tab" else "" for x in element.iter())


def _word_block(element: ElementTree.Element) -> str:
    if _local(element) == "tbl":
        return "\n".join(" | ".join(_runs(c).strip() for c in row if _local(c) == "tc") for row in element if _local(row) == "tr")
    style = next((_attribute(x, "val") for x in element.iter() if _local(x) == "pStyle"), "")
    text = _runs(element)
    depth = re.fullmatch(r"Heading(\d)", style)
    return f"{'#' * int(depth[1])} {text}" if depth and text.strip() else text


def load_docx(raw: bytes) -> str:
    """Headers, then body (headings marked, tables by bars), footnotes, endnotes, footers, comments."""
    out = []
    for part in (r"word/header\d*\.xml", r"word/document\.xml", r"word/footnotes\.xml", r"word/endnotes\.xml", r"word/footer\d*\.xml", r"word/comments\.xml"):
        for _, root in _members(raw, part):
            top = next((x for x in root if _local(x) == "body"), root)
            blocks = [_word_block(x) for x in top] if _local(root) != "footnotes" else [_runs(x) for x in top]
            out += [b for b in blocks if b.strip()]
    return "\n".join(out)


def _shape_place(shape: ElementTree.Element) -> tuple[int, int]:
    off = next((x for x in shape.iter() if _local(x) == "off"), None)
    return int(_attribute(off, "y") or 0), int(_attribute(off, "x") or 0)


def load_pptx(raw: bytes) -> str:
    """Slides in order, shapes from top left, tables by tabs, notes after the slides."""
    out = []
    for n, (_, root) in enumerate(_members(raw, r"ppt/slides/slide\d+\.xml"), 1):
        out.append(f"--- Slide {n} ---")
        shapes = [x for x in root.iter() if _local(x) in ("sp", "graphicFrame")]
        for shape in sorted(shapes, key=_shape_place):
            rows = [x for x in shape.iter() if _local(x) == "tr"]
            lines = ["\t".join(_runs(c).strip() for c in row if _local(c) == "tc") for row in rows] or [_runs(p) for p in shape.iter() if _local(p) == "p"]
            out += [x for x in lines if x.strip()]
    for _, root in _members(raw, r"ppt/notesSlides/notesSlide\d+\.xml"):
        out += [t for t in (_runs(p) for p in root.iter() if _local(p) == "p") if t.strip()]
    return "\n".join(out)


def load_xlsx(raw: bytes) -> str:
    """Sheets in order, rows by bars."""
    shared = [_runs(x) for _, root in _members(raw, r"xl/sharedStrings\.xml") for x in root]
    rows = []
    for _, root in _members(raw, r"xl/worksheets/sheet\d+\.xml"):
        for row in (x for x in root.iter() if _local(x) == "row"):
            cells = []
            for c in (x for x in row if _local(x) == "c"):
                value = next((x.text or "" for x in c if _local(x) == "v"), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else _runs(c) if c.get("t") == "inlineStr" else value)
            rows.append(cells)
    return _lines(rows)


def load_pdf(raw: bytes) -> str:
    """Text operators of uncompressed and deflated page streams, in order; scanned pages have none."""
    import zlib

    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for text in re.finditer(rb"BT(.*?)ET", body, re.S):
            parts = re.findall(rb"\(((?:\\.|[^\\()])*)\)", text[1])
            line = "".join(re.sub(rb"\\([()\\])", rb"\1", p).decode("latin-1") for p in parts)
            if line.strip():
                out.append(line)
    return " ".join(out)


LOADERS: dict[str, Loader] = {
    ".txt": _text, ".md": _text, ".adoc": _text, ".yaml": load_yaml, ".yml": load_yaml,
    ".csv": load_csv, ".json": load_json, ".jsonl": load_jsonl, ".xml": load_xml,
    ".html": lambda raw: page_text(_text(raw)), ".htm": lambda raw: page_text(_text(raw)),
    ".docx": load_docx, ".pptx": load_pptx, ".xlsx": load_xlsx, ".pdf": load_pdf,
}

# First bytes that files of an extension must have; those without a loader here need a registered one.
SIGNATURES = {
    ".docx": b"PK\x03\x04", ".pptx": b"PK\x03\x04", ".xlsx": b"PK\x03\x04", ".pdf": b"%PDF",
    ".doc": b"\xd0\xcf\x11\xe0", ".ppt": b"\xd0\xcf\x11\xe0", ".xls": b"\xd0\xcf\x11\xe0",
    ".png": b"\x89PNG", ".jpg": b"\xff\xd8\xff", ".jpeg": b"\xff\xd8\xff", ".tiff": b"II*\x00", ".wav": b"RIFF",
}
#: Types whose content is text and holds no zero byte.
TEXTUAL = (".txt", ".md", ".adoc", ".yaml", ".yml", ".csv", ".json", ".jsonl", ".xml", ".html", ".htm")


def register_loader(extension: str, loader: Loader, signature: bytes | None = None) -> None:
    """Add a file type, such as speech or scans behind a model."""
    LOADERS[extension.lower()] = loader
    if signature:
        SIGNATURES[extension.lower()] = signature


def supported(name: Column | str) -> Column:
    from ragweave.functions.text import extension

    return extension(name).isin(list(LOADERS))


def extract(files: DataFrame, name_col: str = "path", content_col: str = "content", on_error: str = "raise") -> DataFrame:
    """``files`` (name, content) with text and error instead of the content.

    ``on_error="raise"`` fails the job at the first bad file; ``"keep"`` gives its message as ``error``.
    """
    loaders, signatures = dict(LOADERS), dict(SIGNATURES)

    def one(name: str, raw: bytes | None) -> str:
        kind = (re.search(r"(\.[^./]+)$", name or "") or [""])[0].lower()
        if kind not in loaders:
            raise ValueError(f"{name}: unsupported file type")
        if raw is None:
            raise ValueError(f"{name}: an upload needs a name and data")
        if (kind in signatures and not raw.startswith(signatures[kind])) or (kind in TEXTUAL and b"\0" in raw):
            raise ValueError(f"{name}: content doesn't fit the file type")
        return loaders[kind](raw)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, errors = [], []
            for name, raw in zip(frame[name_col], frame[content_col]):
                try:
                    texts.append(one(name, None if raw is None else bytes(raw)))
                    errors.append(None)
                except Exception as e:
                    if on_error == "raise":
                        raise
                    texts.append(None)
                    errors.append(str(e))
            yield frame.drop(columns=[content_col]).assign(text=texts, error=errors)

    rest = files.drop(content_col).withColumns({"text": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    return files.mapInPandas(run, rest.schema)


def read_files(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """One row per supported file below ``path``: filename, timestamp, size, text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = raw.filter(supported("path")).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("modificationTime").alias("timestamp"), F.col("length").alias("size"), "content")
    return extract(named, "filename", on_error=on_error)


def decode(uploads: DataFrame, data_col: str = "data64", name_col: str = "filename", on_error: str = "raise") -> DataFrame:
    """Uploads with base64 data to (filename, content).

    An empty name or payload is an error, with ``on_error="keep"`` null content, which ``extract`` reports.
    """
    ok = (F.trim(name_col) != "") & (F.length(data_col) > 0)
    bad = F.raise_error(F.lit("an upload needs a name and data")).cast("binary") if on_error == "raise" else F.lit(None).cast("binary")
    return uploads.select(F.col(name_col).alias("filename"), F.when(ok, F.unbase64(data_col)).otherwise(bad).alias("content"))


def texts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows that aren't blank, stamped with the time of the query."""
    return rows.filter(F.trim(text_col) != "").withColumn("timestamp", F.current_timestamp())
