"""Splitting texts into chunks: by separators, headers, tokens, sentences and meaning.

Splits that built-in functions can say are Column expressions; those that carry state along a text are
``mapInArrow`` over whole rows, one row's text at a time, and carry the columns to keep along.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ragweave.functions.text import bind
from ragweave.operators import quantiles, ranges
from ragweave.storage import materialize

# Where a text may be cut, the best place first.
SEPARATORS = ("\n\n", "\n", " ", ".", ",", "​", "，", "、", "．", "。", "")

Chunk = tuple[int, str]


def _check(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("0 <= overlap < size is needed")


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Pieces joined up to ``size`` characters; a chunk starts with what fits of the last one's end."""
    held: list[str] = []
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if held:
        yield "".join(held)


def _cut(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    mark, finer = separators[at], separators[at + 1 :]
    if mark:
        first, *rest = text.split(mark)
        pieces = [p for p in (first, *(mark + r for r in rest)) if p]
    else:
        pieces = list(text)
    short: list[str] = []
    for piece in pieces:
        if len(piece) < size or not finer:
            short.append(piece)
            continue
        yield from _pack(short, size, overlap)
        short = []
        yield from _cut(piece, size, overlap, finer)
    yield from _pack(short, size, overlap)


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[Chunk]:
    """(start, chunk) pairs; chunks are stripped and never blank."""
    _check(size, overlap)
    out: list[Chunk] = []
    at = 0
    for chunk in (c.strip() for c in _cut(text, size, overlap, separators)):
        if chunk:
            start = text.find(chunk, max(0, at))
            out.append((start, chunk))
            at = start + len(chunk) - overlap
    return out


LINK = re.compile(r"\[([^\[\]]+)\]\([^)]*\)")
HEADING = re.compile(r"^(#{1,7})\s+(.*)$")
FENCE = re.compile(r"^\s*(```|~~~)")


def markdown_sections(text: str) -> Iterator[tuple[dict[int, str], str]]:
    """(headings in force by depth, text of the section with its heading line); code fences have no headings."""
    headings: dict[int, str] = {}
    lines: list[str] = []
    fenced = False
    for line in text.split("\n"):
        fenced ^= bool(FENCE.match(line))
        found = None if fenced else HEADING.match(line.strip())
        if found:
            if any(x.strip() for x in lines):
                yield dict(headings), "\n".join(lines)
            depth = len(found[1])
            headings = {d: h for d, h in headings.items() if d < depth} | {depth: LINK.sub(r"\1", found[2]).strip("* ")}
            lines = []
        lines.append(line)
    if any(x.strip() for x in lines):
        yield dict(headings), "\n".join(lines)


def split_markdown(text: str, size: int, overlap: int) -> list[tuple[int, str, dict[int, str]]]:
    return [(start, chunk, headings) for headings, section in markdown_sections(text) for start, chunk in split_recursive(section, size, overlap)]


def sentences_packed(text: str, size: int, overlap: int = 0, count: Callable[[str], int] = lambda s: len(s.split())) -> list[tuple[str, int, int]]:
    """(chunk, first token, last token + 1): whole sentences up to ``size`` tokens.

    A sentence ends at a full stop before white space or the end. A chunk starts with the last whole
    sentences of the one before it that come to at most ``overlap`` tokens; a longer sentence stays whole;
    text after the last full stop belongs to no chunk, and a text without one is a chunk.
    """
    ends = [m.end() for m in re.finditer(r"\.(?=\s|$)", text)]
    if not ends:
        return [(text, 0, count(text))] if text.strip() else []
    parts = [text[a:b] for a, b in zip([0, *ends], ends)]
    sizes = [count(p) for p in parts]
    before = [sum(sizes[:i]) for i in range(len(parts) + 1)]
    out, i = [], 0
    while True:
        j = i + 1
        while j < len(parts) and before[j + 1] - before[i] <= size:
            j += 1
        out.append(("".join(parts[i:j]), before[i], before[j]))
        if j == len(parts):
            return out
        back = j
        while back - 1 > i and before[j] - before[back - 1] <= overlap:
            back -= 1
        i = back


CHUNKS = T.ArrayType(T.StructType([T.StructField("start_index", T.IntegerType()), T.StructField("text", T.StringType())]))


def _exploded(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[str], list[tuple]], keep: Sequence[str] = ()) -> DataFrame:
    """One row per part that ``make`` cuts from a text: the id, the columns to ``keep``, chunk number, and the part's columns."""
    made = T.StructType.fromDDL(f"chunk int, {schema}")
    own = [f.name for f in made]
    names = [id_col, *(k for k in keep if k != id_col)]
    clash = {n.lower() for n in names} & {n.lower() for n in own}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are those of chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(made)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                rows, out = [], []
                for i, text in enumerate(part.column(text_at).to_pylist()):
                    cut = make(text) if text else []
                    rows += [i] * len(cut)
                    out += [(n, *c) for n, c in enumerate(cut)]
                index = pa.array(rows, pa.int32())
                columns = [pa.array([x[j] for x in out], kinds.field(j).type) for j in range(len(own))]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(index) for c in range(text_at)), *columns], [*names, *own])

    text_at = len(names)
    return df.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, T.StructType([*(df.schema[n] for n in names), *made]))


def recursive(df: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, kept columns, chunk, start_index, chunk_text) of every text; blank texts have no chunks."""
    _check(size, overlap)
    return _exploded(df, id_col, text_col, "start_index int, chunk_text string", lambda t: split_recursive(t, size, overlap), keep)


def markdown(df: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """As ``recursive`` under Markdown headings, with columns header1 to header7."""
    _check(size, overlap)
    make = lambda t: [(s, c, *(h.get(d) for d in range(1, 8))) for s, c, h in split_markdown(t, size, overlap)]
    return _exploded(df, id_col, text_col, "start_index int, chunk_text string, " + ", ".join(f"header{d} string" for d in range(1, 8)), make, keep)


def sentences(df: DataFrame, size: int, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, kept columns, chunk, chunk_text, first_token, last_token) by whole sentences."""
    return _exploded(df, id_col, text_col, "chunk_text string, first_token int, last_token int", lambda t: sentences_packed(t, size, overlap), keep)


def by_extension(df: DataFrame, size: int, overlap: int, name_col: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Markdown splitting for Markdown-like files, recursive for others; one schema."""
    from ragweave.functions.text import extension

    marked = extension(name_col).isin(".md", ".adoc", ".html")
    plain = recursive(df.filter(~F.coalesce(marked, F.lit(False))), size, overlap, id_col, text_col, keep)
    return markdown(df.filter(marked), size, overlap, id_col, text_col, keep).unionByName(plain, allowMissingColumns=True)


Splitter = Callable[..., DataFrame]
SPLITTERS: dict[str, Splitter] = {"recursive": recursive, "markdown": markdown, "sentences": sentences}


def register_splitter(name: str, splitter: Splitter) -> None:
    """Add a splitter (df, size, overlap, id_col, text_col, keep) by name."""
    SPLITTERS[name] = splitter


def split(df: DataFrame, name: str, size: int, overlap: int, **options: object) -> DataFrame:
    """``df`` split by the splitter of that name; an unknown one is an error."""
    if name not in SPLITTERS:
        raise ValueError(f"unknown splitter {name}")
    return SPLITTERS[name](df, size, overlap, **options)


def with_metadata(df: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunk rows that carry every other column of their document; a chunk's own columns win over equal names."""
    own = {"chunk", "start_index", "chunk_text"}
    keep = [c for c in df.columns if c not in (id_col, text_col) and c.lower() not in own]
    return recursive(df, size, overlap, id_col, text_col, keep)


def hierarchical_pages(pages: DataFrame, summarize: Callable[[DataFrame, str], DataFrame], size: int = 1000, overlap: int = 200, id_col: str = "doc_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """(id, page, summary, chunk, start_index, text): a summary (1) of each page and the chunks (0) it splits into.

    ``summarize(df, text_col)`` replaces that column by its summary. Chunks never cross pages.
    """
    short = summarize(pages.select(id_col, page_col, F.col(text_col).alias("text")), "text")
    short = short.select(id_col, page_col, F.lit(1).alias("summary"), F.lit(0).alias("chunk"), F.lit(0).alias("start_index"), "text")
    parts = recursive(pages, size, overlap, id_col, text_col, [page_col])
    return short.unionByName(parts.select(id_col, page_col, F.lit(0).alias("summary"), "chunk", "start_index", F.col("chunk_text").alias("text")))


def token_windows(tokens: Column, size: int, overlap: int) -> Column:
    """Array of (first, tokens) windows of ``size`` every ``size - overlap``; short ones at the end stay."""
    if size < 4:
        raise ValueError("a window has at least 4 tokens")
    _check(size, overlap)

    def windows(t: Column) -> Column:
        starts = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("first"), F.slice(t, i + 1, size).alias("tokens")))

    return bind(tokens, windows)


def fixed_tokens(df: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, first_token, last_token, chunk_text) over white-space tokens."""
    tokens = F.filter(F.split(text_col, r"\s+"), lambda w: w != "")
    rows = df.select(id_col, F.posexplode(token_windows(tokens, size, overlap)).alias("chunk", "w"))
    return rows.select(id_col, "chunk", F.col("w.first").alias("first_token"), (F.col("w.first") + F.size("w.tokens")).alias("last_token"), F.array_join("w.tokens", " ").alias("chunk_text"))


def pool_spans(vectors: DataFrame, spans: DataFrame, group: str, dims: int, position: str = "position", vec_col: str = "embedding") -> DataFrame:
    """(group, span, pooled): mean of the vectors at positions [first, last) of each span; empty spans go.

    A span is exploded to its positions, which meet vectors by equality, so a group's vectors and spans are
    never paired. Coordinates are averaged each, pre-aggregated, so a span's rows never meet as rows.
    """
    at = spans.filter("last > first").select(group, "span", F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long") - 1)).alias("__at"))
    inside = vectors.withColumn("__at", F.col(position).cast("long")).join(at, [group, "__at"])
    means = [F.avg(F.col(vec_col)[i].cast("double")).alias(f"v{i}") for i in range(dims)]
    return inside.groupBy(group, "span").agg(*means).select(group, "span", F.array(*[f"v{i}" for i in range(dims)]).alias("pooled"))


def late_chunks(texts: DataFrame, embed_tokens: Callable[[DataFrame], DataFrame], size: int, overlap: int, dims: int, macro: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, chunk_text, embedding): token vectors of whole macro-chunks, pooled by the chunks inside them.

    A text's white-space tokens go to the model in macro-chunks of ``macro`` tokens, so that every token sees
    its surroundings; ``embed_tokens`` turns rows (id, macro, token array) into rows (id, macro, position,
    embedding) with positions inside the macro-chunk. Chunks of ``size`` tokens are windows of a macro-chunk, so a
    position says which ones hold it: vectors are added up where they are made, and only sums are shuffled.
    """
    if macro < size:
        raise ValueError("a macro-chunk holds at least a chunk")
    words = texts.select(id_col, F.filter(F.split(text_col, r"\s+"), lambda w: w != "").alias("tokens"))
    parts = words.select(id_col, F.posexplode(token_windows(F.col("tokens"), macro, 0)).alias("macro", "w")).select(id_col, "macro", F.col("w.tokens").alias("tokens"))
    spans = parts.select(id_col, "macro", F.posexplode(token_windows(F.col("tokens"), size, overlap)).alias("n", "w"))
    key = F.struct(id_col, "macro")
    spans = spans.select(key.alias("part"), F.col("n").alias("span"), F.col("w.first").alias("first"), (F.col("w.first") + F.size("w.tokens")).alias("last"), F.array_join("w.tokens", " ").alias("chunk_text"))
    at, step = F.col("__at"), size - overlap
    vectors = embed_tokens(parts).select(key.alias("part"), F.col("position").cast("long").alias("__at"), "embedding").filter("__at >= 0")
    inside = F.sequence(F.greatest(F.floor((at - size) / step) + 1, F.lit(0)), F.floor(at / step))  # the windows that hold a position
    means = [F.avg(F.col("embedding")[i].cast("double")).alias(f"v{i}") for i in range(dims)]
    pooled = vectors.select("part", F.explode(inside.cast("array<int>")).alias("span"), "embedding").groupBy("part", "span").agg(*means)
    pooled = pooled.select("part", "span", F.array(*[f"v{i}" for i in range(dims)]).alias("pooled"))
    return pooled.join(spans.select("part", "span", "chunk_text"), ["part", "span"]).select(F.col(f"part.{id_col}").alias(id_col), F.struct("part.macro", "span").alias("chunk"), "chunk_text", F.col("pooled").alias("embedding"))


def semantic_groups(steps: DataFrame, group: str, position: str, distance: str, percentile: float = 0.95) -> DataFrame:
    """``steps`` with is_break and part: a part ends where the distance to the next row is above the percentile.

    The percentile is selected, and breaks are counted by ranges of the position, so a group isn't gathered.
    """
    steps = materialize(steps, "steps")
    exact = quantiles.percentiles(steps, [group], distance, {"limit": percentile})
    limits = materialize(exact.select(F.col(group).alias("__group"), "limit"), "limits")
    marked = steps.join(limits, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")
    marked = marked.withColumn("is_break", F.coalesce(F.col(distance) > F.col("limit"), F.lit(False)))
    return ranges.running(marked, [group], position, position, F.col("is_break").cast("long"), "part", inclusive=False)


def semantic(df: DataFrame, embed: Callable[[DataFrame, str], DataFrame], buffer: int = 1, percentile: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, chunk_text): sentences, each embedded with its neighbours, cut where meaning jumps.

    ``embed(df, text_col)`` adds the column ``embedding``.
    """
    from ragweave.functions.vectors import distance

    sentences = F.split(text_col, r"(?<=[.!?])\s+")
    near = lambda s, i: F.array_join(F.slice(s, F.greatest(i - buffer, F.lit(0)) + 1, F.least(i, F.lit(buffer)) + buffer + 1), " ")
    each = bind(sentences, lambda s: F.transform(s, lambda x, i: F.struct(i.alias("position"), x.alias("sentence"), near(s, i).alias("combined"))))
    combined = df.select(id_col, F.explode(each).alias("x")).select(id_col, "x.*")
    line = Window.partitionBy(id_col).orderBy("position")
    steps = embed(combined, "combined").withColumn("step", distance("embedding", F.lead("embedding").over(line)))
    # a text's sentences are no more than the text, so its percentile and parts are found in one row
    held = steps.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("position", "sentence", "step"))).alias("s"))
    known = held.withColumn("v", F.array_sort(F.filter(F.transform("s", lambda x: x["step"]), lambda x: x.isNotNull())))
    at = (F.size("v") - 1) * F.lit(percentile)
    part = at - F.floor(at)
    limit = F.get("v", F.floor(at).cast("int")) * (1 - part) + F.get("v", F.ceil(at).cast("int")) * part
    ends = F.filter(F.transform("s", lambda x, i: F.when(x["step"] > F.col("limit"), i + 1)), lambda x: x.isNotNull())
    cut = known.withColumn("limit", limit).select(id_col, F.transform("s", lambda x: x["sentence"]).alias("s"), ends.alias("ends"))
    spans = F.arrays_zip(F.concat(F.array(F.lit(0)), "ends").alias("a"), F.concat("ends", F.array(F.size("s"))).alias("b"))
    texts = F.transform(spans, lambda z: F.array_join(F.slice("s", z["a"] + 1, z["b"] - z["a"]), " "))
    return cut.select(id_col, F.posexplode(texts).alias("part", "chunk_text")).withColumn("part", F.col("part").cast("long"))


# Where speech may be cut, after sentence ends and commas.
SPEECH_CUTS = r"(?<=[.!?])\s+|(?<=,)\s+"


def sentence_pack(x: Column | str, size: int) -> Column:
    """Array of speech parts: cut after sentence ends and commas, joined by spaces up to ``size`` characters.

    A pass over the pieces' lengths numbers the part of each piece; texts are joined once, at the end.
    """
    pieces = F.filter(F.split(F.col(x) if isinstance(x, str) else x, SPEECH_CUTS), lambda p: F.trim(p) != "")

    def parts(p: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("firsts"), F.lit(0).alias("held"), F.lit(0).alias("at"))

        def step(acc: Column, n: Column) -> Column:
            new = (acc["at"] == 0) | (acc["held"] + 1 + n > size)
            firsts = F.when(new, F.concat(acc["firsts"], F.array(acc["at"]))).otherwise(acc["firsts"])
            return F.struct(firsts.alias("firsts"), F.when(new, n).otherwise(acc["held"] + 1 + n).alias("held"), (acc["at"] + 1).alias("at"))

        firsts = F.aggregate(F.transform(p, lambda t: F.length(t)), start, step, lambda acc: acc["firsts"])
        ends = F.concat(F.slice(firsts, 2, F.greatest(F.size(firsts) - 1, F.lit(0))), F.array(F.size(p)))
        return F.transform(F.arrays_zip(firsts.alias("a"), ends.alias("b")), lambda z: F.array_join(F.slice(p, z["a"] + 1, z["b"] - z["a"]), " "))

    return bind(pieces, lambda p: F.when(F.size(p) > 0, parts(p)).otherwise(F.array().cast("array<string>")))
