"""Removal of byte strings that occur twice, by column-wise construction over anchored contexts.

Every window of ``span`` bytes has an anchor: the leftmost of its ``ANCHOR``-byte strings with the
smallest hash. Equal windows have equal anchors at equal places, so only windows of one anchor need
comparing. A run of windows with the same anchor occurrence is a context of less than two spans.

Contexts that occur at two places settle all their windows by their fingerprints. For anchors that
have several contexts, one occurrence of each context is a document of a collection, aligned at the
anchor, and the sorted order of all suffixes is built column by column from the right: each round puts
one symbol before every document, moves the order as a Burrows-Wheeler transform does (by symbol, else
as before), and updates the common prefixes of neighbours by range minima. A window is repeated if the
prefix that it shares with a neighbour is as long as the window. The rounds are as many as a context
has bytes, not as many as the longest document; contexts come to a task sorted by anchor, as one
sequential stream, and a batch of anchors is advanced at once.

An anchor with over ``MOST_CONTEXTS`` contexts isn't gathered: its windows' fingerprints are counted
by pre-aggregated grouping instead, which gives the same spans.

Results in special cases: null text counts as empty; texts shorter than ``span`` keep all bytes; rows
that repeat both doc_id and text are one document; a null doc_id is a document like others; occurrences
that overlap count as different places; an empty table gives an empty result; very long texts are taken
in pieces, whole. ``cut_repeats`` keeps all columns, drops characters that lose some of their bytes,
and leaves documents of which nothing is left with empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.llm import bytehash
from ragweave.llm.common import discard, free_name, materialize, ragged, row_blocks, semi_join, text_views

SPAN, ANCHOR = 200, 50
#: Contexts of an anchor that one task compares, contexts advanced at once, bytes of texts taken at once.
MOST_CONTEXTS, BATCH, BLOCK = 20_000, 20_000, 1 << 20
#: Bits of a packed place: position << 20 | windows before the anchor << 10 | those at least before it.
SHIFT = 10


def anchors(data: np.ndarray, offsets: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, anchor position, first and last window start of each context, and its fingerprint."""
    wide = span - k + 1
    prefix = bytehash.Prefix(data)
    h = prefix.every(k)
    low = np.uint64((1 << 22) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(h) // wide) + 1
    grid = np.full(blocks * wide, ~np.uint64(0))
    grid[: len(h)] = key
    grid = grid.reshape(blocks, wide)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    lengths = np.diff(offsets)
    rows = np.flatnonzero(lengths >= span)
    counts = lengths[rows] - span + 1
    starts = ragged(offsets[rows], counts)
    row = np.repeat(rows, counts)
    at = (np.minimum(behind[starts], ahead[starts + wide - 1]) & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    a, b = starts[first], starts[last]
    return row[first], h[at[first]], at[first], a, b, prefix.windows(a, b + span)


PLACES = "anchor long, context long, doc_id long, uid long, place long"


def _pieces(offsets: np.ndarray, a: int, b: int, span: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of rows [a, b): all at once, or overlapping pieces of a single long row."""
    begin, end = int(offsets[a]), int(offsets[b])
    if end - begin <= 2 * BLOCK:
        yield begin, end
        return
    while begin < end:
        yield begin, min(end, begin + BLOCK + span - 1)
        begin += BLOCK


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("uid"), text.alias("text"))


def find_anchors(docs: DataFrame, span: int, k: int) -> DataFrame:
    """One row per context of docs (doc_id, uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(2))
            for a, b in row_blocks(offsets, BLOCK):
                for begin, end in _pieces(offsets, a, b, span):
                    own = np.clip(offsets[a : b + 1], begin, end) - begin
                    row, h, at, first, last, seal = anchors(data[begin:end], own, span, k)
                    base = begin - offsets[a + row]
                    packed = ((at + base) << (2 * SHIFT)) | ((at - first) << SHIFT) | (at - last)
                    index = pa.array(a + row)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(seal.view(np.int64)), batch.column(0).take(index), batch.column(1).take(index), pa.array(packed)], [x.split()[0] for x in PLACES.split(", ")])

    return docs.mapInArrow(run, PLACES)


def repeated_windows(texts: list[np.ndarray], group: np.ndarray, left: np.ndarray, right: np.ndarray, span: int) -> list[np.ndarray]:
    """For each context, which of its window starts (first to last) another context of its group shares.

    ``texts[i]`` begins ``left[i]`` bytes before the anchor and ends ``span - right[i]`` after it.
    """
    n = len(texts)
    most = int(left.max())
    width = most + span - int(right.min())
    grid = np.zeros((width, n), np.int16)
    sizes = np.array([len(t) for t in texts])
    column = ragged(most - left, sizes)
    grid[column, np.repeat(np.arange(n), sizes)] = np.concatenate(texts).astype(np.int16) + 1
    marked = np.zeros((n, most - int(right.min()) + 1), bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(n + 1, np.int64)  # with the one before, in the order
    for c in range(width - 1, -1, -1):
        symbol = grid[c][order].astype(np.int64)
        key = group[order] * 512 + symbol
        move = np.argsort(key, kind="stable")
        same = np.zeros(n, bool)
        same[1:] = (key[move][1:] == key[move][:-1]) & (symbol[move][1:] > 0)
        to = np.flatnonzero(same)
        fresh = np.zeros(n + 1, np.int64)
        if len(to):
            pairs = np.stack([move[to - 1] + 1, move[to] + 1], 1).reshape(-1)
            fresh[to] = np.minimum(1 + np.minimum.reduceat(common, pairs)[::2], span)
        order, common = order[move], fresh
        if c < marked.shape[1]:
            full = common >= span
            marked[order, c] = full[:-1] | full[1:]
    return [marked[i, most - left[i] : most - right[i] + 1] for i in range(n)]


def _runs(flags: np.ndarray) -> np.ndarray:
    """(first, last + 1) of the runs of true flags."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).reshape(-1, 2)


SPANS = "doc_id long, uid long, first long, stop long"
CONTEXTS = "anchor long, doc_id long, uid long, place long, bytes binary"


def _contexts(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes of the contexts at places wanted (anchor, doc_id, uid, place), for each row that is the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column("text"))
            for i in range(batch.num_rows):
                rows = batch.column("places")[i].values
                place, anchor = rows.field("place").to_numpy(), rows.field("anchor")
                at, left, right = place >> 20, (place >> SHIFT) & 1023, place & 1023
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                cut = [raw[a:b] for a, b in zip((at - left).tolist(), (at - right + span).tolist())]
                index = pa.array(np.full(len(place), i))
                yield pa.RecordBatch.from_arrays([anchor, batch.column("doc_id").take(index), batch.column("uid").take(index), pa.array(place), pa.array(cut, pa.binary())], ["anchor", "doc_id", "uid", "place", "bytes"])

    lists = wanted.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("anchor", "place")).alias("places"))
    both = _join_docs(docs, lists, "inner")
    return both.select("doc_id", "uid", "text", "places").mapInArrow(run, CONTEXTS)


def _join_docs(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    right = lists.withColumnsRenamed({"doc_id": "__id", "uid": "__uid"})
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("uid") == F.col("__uid")), how)


def _by_columns(contexts: DataFrame, span: int) -> DataFrame:
    """Spans of windows that contexts of an anchor share, by column-wise construction."""

    def solve(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        doc = table.column("doc_id")
        places = pd.DataFrame({"id": pc.fill_null(doc, 0).to_numpy(), "no_id": pc.is_null(doc).to_numpy()} | {c: table.column(c).to_numpy() for c in ("anchor", "uid", "place")})
        table = table.take(np.flatnonzero(~places.duplicated().to_numpy()))  # rows that repeat a document
        place = table.column("place").to_numpy()
        at, left, right = place >> 20, (place >> SHIFT) & 1023, place & 1023
        group = np.unique(table.column("anchor").to_numpy(), return_inverse=True)[1]
        texts = [np.frombuffer(x, np.uint8) for x in table.column("bytes").to_pylist()]
        found = [_runs(x) for x in repeated_windows(texts, group, left, right, span)]
        index = np.repeat(np.arange(len(found)), [len(x) for x in found])
        runs = np.concatenate(found)
        start = (at - left)[index]
        pick = pa.array(index)
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(pick) for c in ("doc_id", "uid")), pa.array(start + runs[:, 0]), pa.array(start + runs[:, 1] - 1 + span)], ["doc_id", "uid", "first", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                table = pa.Table.from_batches([batch])
                names = batch.column("anchor").to_numpy()
                if n >= BATCH:  # the rest of the last anchor, then a new stream
                    last = held[-1].column("anchor")[-1].as_py()
                    end = int(np.searchsorted(names != last, True))
                    if end:
                        held.append(table.slice(0, end))
                    if end == batch.num_rows:
                        break
                    yield solve(held)
                    held, n, batch = [], 0, batch.slice(end)
                    continue
                take = min(batch.num_rows, BATCH - n)
                held.append(table.slice(0, take))
                n, batch = n + take, batch.slice(take)
        if n:
            yield solve(held)

    rows = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, SPANS)


def _by_counting(contexts: DataFrame, span: int) -> DataFrame:
    """The same spans by counting fingerprints of windows, for anchors with very many contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column("bytes")[i].as_py(), np.uint8)
                prefix = bytehash.Prefix(raw)
                a, b = prefix.every(span), bytehash.Prefix(raw ^ np.uint8(0x5A)).every(span)
                place = batch.column("place")[i].as_py()
                first = (place >> 20) - ((place >> SHIFT) & 1023)
                same = pa.array(np.full(len(a), i))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column("doc_id").take(same), batch.column("uid").take(same), pa.array(first + np.arange(len(a)))], ["a", "b", "doc_id", "uid", "first"])

    windows = contexts.mapInArrow(run, "a long, b long, doc_id long, uid long, first long")
    where = F.xxhash64("doc_id", "uid", "first")
    twice = windows.groupBy("a", "b").agg(F.min(where).alias("x"), F.max(where).alias("y")).filter("x <> y").select("a", "b")
    return windows.join(twice, ["a", "b"], "left_semi").select("doc_id", "uid", "first", (F.col("first") + span).alias("stop"))


def repeated_spans(keyed: DataFrame, span: int = SPAN, k: int = ANCHOR) -> DataFrame:
    """(doc_id, uid, spans) with the byte ranges [first, stop) of documents (doc_id, uid, text)."""
    where = F.xxhash64("doc_id", "uid", "place")
    every = materialize(find_anchors(keyed, span, k), "anchors")
    ends = [F.count("*").alias("n"), F.min(where).alias("x"), F.max(where).alias("y")]
    # tables of their own, so that joins with them have plain exchanges; the hottest keys are broadcast
    twice = materialize(every.groupBy("anchor").agg(*ends).filter("x <> y").select("anchor", "n"), "twice")
    places = materialize(semi_join(every, twice, ["anchor"]), "places")
    discard(every)
    contexts = materialize(places.groupBy("anchor", "context").agg(*ends), "contexts")
    several = materialize(contexts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "several")
    settled = semi_join(places, contexts.filter("x <> y"), ["anchor", "context"])
    left, right = F.shiftright("place", SHIFT).bitwiseAND(1023), F.col("place").bitwiseAND(1023)
    at = F.shiftright("place", 2 * SHIFT)
    settled = settled.select("doc_id", "uid", (at - left).alias("first"), (at - right + span).alias("stop"))
    shown = contexts.select("anchor", "context", "x").join(several, "anchor").select("anchor", "context", "x", "n")
    wanted = places.withColumn("x", where).join(shown, ["anchor", "context", "x"]).dropDuplicates(["anchor", "context"])
    size = several.select("anchor", "n")
    bytes_of = materialize(_contexts(keyed, wanted.select("anchor", "doc_id", "uid", "place"), span), "context-bytes")
    small = bytes_of.join(size.filter(F.col("n") <= MOST_CONTEXTS), "anchor", "left_semi")
    large = bytes_of.join(size.filter(F.col("n") > MOST_CONTEXTS), "anchor", "left_semi")
    found = settled.unionByName(_by_columns(small, span)).unionByName(_by_counting(large, span))
    spans = materialize(found.distinct(), "spans")
    discard(bytes_of)
    return spans.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))


def _kept(size: int, spans: pa.StructArray | None) -> tuple[np.ndarray, int]:
    """Which bytes stay, and the number of runs that go."""
    if spans is None:
        return np.ones(size, bool), 0
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, spans.field("first").to_numpy(), 1)
    np.add.at(edge, spans.field("stop").to_numpy(), -1)
    gone = np.cumsum(edge)[:-1] > 0
    return ~gone, len(_runs(gone))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(docs: DataFrame, span: int = SPAN, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column("text"))
            out = []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                keep, runs = _kept(len(raw), batch.column("spans")[i].values)
                out.append((len(raw), len(raw) - int(keep.sum()), runs, hashlib.sha256(raw[keep].tobytes() if runs else raw.tobytes()).hexdigest()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*out), kinds))], [x.split()[0] for x in REPORT.split(", ")])

    keyed = _keyed(docs, id_col, text_col)
    both = _join_docs(keyed, repeated_spans(keyed, span, k), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(run, REPORT)


def cut_repeats(docs: DataFrame, span: int = SPAN, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated bytes of ``text_col``; null texts stay null, ``n_chars`` follows."""
    spans = repeated_spans(_keyed(docs, id_col, text_col), span, k)
    key, uid, cut = (free_name(docs, x) for x in ("cut_id", "cut_uid", "cut_spans"))
    spans = spans.select(F.col("doc_id").alias(key), F.col("uid").alias(uid), F.col("spans").alias(cut))
    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(uid)), "left").drop(key, uid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, found = batch.column(text_col), batch.column(cut)
            out = []
            for i in range(batch.num_rows):
                text = column[i].as_py()
                if text and found[i].values is not None:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    text = raw[_kept(len(raw), found[i].values)[0]].tobytes().decode(errors="ignore")
                out.append(text)
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).drop_columns([cut])

    left = joined.mapInArrow(run, T.StructType(docs.schema.fields))
    return left.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left
