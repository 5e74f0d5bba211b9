"""Collocations: phrases of up to five words that occur often, scored by their weakest cut.

A shard (a lot of about ``LOT`` words in a task) is a count trie of limited depth: each level is one sorted
array of (parent node, word), its words ranked by their bytes, so the trie comes out serialised in path
order. A task adds up the tries of its shards and writes them as sorted blocks of (lang, phrase, count), one
for each range of first words that it has; the blocks of a range meet in one task, which merges them as they
stream by and gives out the paths that occur often enough: the merge by prefix range.

A phrase can only be frequent if all its parts are. So the depth grows in three readings: the first adds
up words and pairs by hash buckets, the second builds tries of the words and pairs whose buckets reach the
least count and adds up three to five words of such pairs, the third builds the deeper tries of what
reaches it. The buckets that reach it, and the frequent pairs, go to the tasks as filters of at most ``MOST_BITS`` bits whatever the input: an element that a filter takes for
frequent by mistake is counted too and falls out at the merge, so a filter's size never changes a result.

The merged trie holds the frequent nodes alone. Walking it level by level gives each node its left parts
from its parent; its suffix link, the node without the first word, hands on the right parts. A node
with a child, or a node that links to it, of equal count lies inside a longer phrase each time and is
dropped: a longer phrase further off that does so implies one of these.

Results in special cases: null text is empty, null lang is ``und``; an empty table, or one without
frequent phrases, gives no rows; words may be of any length; rows that repeat count each; very long texts
are taken whole, in blocks that end between pieces; other columns are ignored. Arithmetic is exact: in
decimals of 38 digits, of which 1000 * a * n has fewer up to 10 ** 17 words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragweave.llm import bytehash
from ragweave.llm.common import discard, materialize, text_views

DEPTH, LEAST, TOP = 5, 100, 2000
#: Words of a shard's trie, bytes of texts cut into words at once, rows of a serialised batch.
LOT, BLOCK, ROWS = 1 << 18, 1 << 20, 1 << 15
#: Rows of serialised tries that a task merges before it gives them out.
MERGE = 1 << 19
#: Bits of a filter: 16 for each element or one for ``BYTES`` of text, but never more than these; and a Bloom filter's hashes.
MOST_BITS, BYTES, HASHES = 1 << 27, 48, 2
#: Bits of a bucket's place within its segment, and bytes of text whose buckets one task adds up.
SEGMENT, SHARE = 16, 1 << 36
#: Parts of a language that are ranked apart before its first rows are.
PARTS = 256

#: 0 in a word, 1 between words of a piece, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

NODES = "lang string, phrase string, d int, n long"
#: A sorted block of such rows, packed, of a range of first words.
RUNS = "range int, block binary"
#: Saturated counts of the buckets of a segment, by words of an element (kind 1 to 5); kind 0: n words of lang.
TALLY = "kind int, segment int, lot int, places binary, counts binary, lang string, n long"
#: Both kinds of rows.
MIXED = f"{TALLY}, range int, block binary"


def _blocks(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that end with a row or between two pieces."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + most)
        stop = int(offsets[np.searchsorted(offsets, end)])
        while end < stop:
            hit = np.flatnonzero(KIND[data[end : min(stop, end + 65536)]] == 2)
            if len(hit):
                end += int(hit[0])
                break
            end = min(stop, end + 65536)
        yield at, end
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Lower-cased words of the rows, whether the next word follows in the same piece, and the row of each."""
    for at, end in _blocks(data, offsets, most):
        part = bytehash.LOWER[data[at:end]]
        kind = KIND[part]
        word = kind == 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = offsets[(offsets > at) & (offsets < end)] - at
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            continue
        row = np.searchsorted(offsets, starts + at, "right") - 1
        breaks = np.concatenate([[0], np.cumsum(kind == 2, dtype=np.int32)])
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (breaks[ends[:-1]] == breaks[starts[1:]]) & (row[:-1] == row[1:])
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        yield pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(part[word])]), follows, row


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, some at a time so that the prefix sums stay small."""
    parts = [text_views(words.slice(a, ROWS)) for a in range(0, len(words), ROWS)]
    return np.concatenate([bytehash.Prefix(data).windows(at[:-1], at[1:]) for data, at in parts] or [np.zeros(0, np.uint64)])


def joined(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that grow by one word."""
    return bytehash.mix(hashes * np.uint64(0x9FB21C651E98DF25) + word + np.uint64(1))


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each element in a filter of ``bits`` (a power of two)."""
    return [(hashes >> np.uint64(31 * i)) & np.uint64(bits - 1) for i in range(HASHES)]


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which elements a filter has, or seems to have."""
    found = np.ones(len(hashes), bool)
    for at in places(hashes, 8 * len(bitmap)):
        found &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def reaches(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which elements are in a bucket that reaches the least count."""
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _phrase_hashes(lang: pa.Array, words: list[pa.Array]) -> np.ndarray:
    return functools.reduce(joined, map(hashed, words), hashed(lang))


class Shard:
    """Words of a lot, and the trie that is built over them."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.lots: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[None]:
        """Take the words of a batch (lang, text); yields whenever a lot is full."""
        langs = batch.column(0).fill_null("und").dictionary_encode()
        codes = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs.dictionary.to_pylist()], np.int64)
        own = codes[langs.indices.to_numpy()]
        data, offsets = text_views(batch.column(1))
        for words, follows, row in words_of(data, offsets):
            self.lots.append((words, follows, own[row]))
            self.size += len(words)
            if self.size >= LOT:
                yield

    def _taken(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        words = pa.concat_arrays([x[0] for x in self.lots])
        follows, lang = (np.concatenate([x[i] for x in self.lots]) for i in (1, 2))
        self.lots, self.size = [], 0
        return words, follows, lang

    def tally(self, bits: int, least: int, lot: int) -> Iterator[pa.RecordBatch]:
        """Counts of the lot's words and pairs by bucket, and of words by language; an empty lot follows."""
        if not self.size:
            return
        words, follows, lang = self._taken()
        langs = pa.array(list(self.langs), pa.string())
        own, word = hashed(langs)[lang], hashed(words)
        single, at = joined(own, word), np.flatnonzero(follows)
        pairs = joined(single[at], word[at + 1])
        for kind, hashes in ((1, single), (2, pairs)):
            yield from _tallied(kind, lot, *np.unique(hashes & np.uint64(bits - 1), return_counts=True), least)
        n = np.bincount(lang, minlength=len(langs))
        none = pa.array([None] * len(n), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), pa.array(np.zeros(len(n), np.int32)), pa.array(np.full(len(n), lot, np.int32)), none, none, langs, pa.array(n.astype(np.int64))], TALLY_NAMES)

    def runs(self, least: int, words_reach: np.ndarray, pairs_reach: np.ndarray, lot: int) -> Iterator[pa.RecordBatch]:
        """The serialised trie of depths 1 and 2 by filters of buckets, and tallies of longer phrases; an empty lot follows."""
        if not self.size:
            return
        names, langs, word, width, lang, at = self._ranked()
        keys, node, counts = np.unique(lang * width + word, return_inverse=True, return_counts=True)
        langs_of, paths, word_hashes = keys // width, [keys % width], hashed(names)
        hashes = joined(hashed(langs)[langs_of], word_hashes[paths[0]])
        known = reaches(words_reach, hashes)
        yield from _serialised(langs, names, langs_of[known], [paths[0][known]], counts[known])
        known = known[node]
        at = at[known[at] & known[at + 1]]
        keys, node, counts = np.unique(node[at] * width + word[at + 1], return_inverse=True, return_counts=True)
        parent, own = keys // width, keys % width
        hashes = joined(hashes[parent], word_hashes[own])
        known = reaches(pairs_reach, hashes)
        yield from _serialised(langs, names, langs_of[parent][known], [paths[0][parent][known], own[known]], counts[known])
        at, node = at[known[node]], node[known[node]]
        paired = np.zeros(len(word) + DEPTH, bool)
        paired[at] = True
        hashes = hashes[node]
        for d in range(3, DEPTH + 1):
            more = paired[at + d - 2]
            at, hashes = at[more], joined(hashes[more], word_hashes[word[at[more] + d - 1]])
            yield from _tallied(d, lot, *np.unique(hashes & np.uint64(8 * len(pairs_reach) - 1), return_counts=True), least)

    def deep(self, pair: np.ndarray, longer_reach: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The serialised trie from depth 3 on, by a filter of pairs and one of buckets for each further depth; an empty lot follows."""
        if not self.size:
            return
        names, langs, word, width, lang, at = self._ranked()
        word_hashes = hashed(names)
        keys, node = np.unique(lang * width + word, return_inverse=True)
        langs_of, paths = keys // width, [keys % width]
        hashes = joined(hashed(langs)[langs_of], word_hashes[paths[0]])
        keys, node = np.unique(node[at] * width + word[at + 1], return_inverse=True)
        parent, own = keys // width, keys % width
        langs_of, paths, hashes = langs_of[parent], [paths[0][parent], own], joined(hashes[parent], word_hashes[own])
        known = holds(pair, hashes)[node]
        at, node = at[known], node[known]
        runs_on = np.zeros(len(word) + DEPTH, bool)  # where a phrase of one word less is that may go on
        runs_on[at] = True
        for d in range(3, DEPTH + 1):
            more = runs_on[at + 1]
            at, node = at[more], node[more]
            keys, node, counts = np.unique(node * width + word[at + d - 1], return_inverse=True, return_counts=True)
            parent, own = keys // width, keys % width
            langs_of, paths, hashes = langs_of[parent], [*(p[parent] for p in paths), own], joined(hashes[parent], word_hashes[own])
            known = reaches(longer_reach[d - 3], hashes)
            at, node = at[known[node]], node[known[node]]
            runs_on[:] = False
            runs_on[at] = True
            yield from _serialised(langs, names, langs_of[known], [p[known] for p in paths], counts[known])

    def _ranked(self) -> tuple[pa.Array, pa.Array, np.ndarray, int, np.ndarray, np.ndarray]:
        """The lot's words in byte order, its languages, each word's rank, their number, its language, and the words that another follows."""
        words, follows, lang = self._taken()
        words = words.dictionary_encode()
        order = pc.sort_indices(words.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        return words.dictionary.take(order), pa.array(list(self.langs), pa.string()), rank[words.indices.to_numpy()], len(order), lang, np.flatnonzero(follows)


TALLY_NAMES = ["kind", "segment", "lot", "places", "counts", "lang", "n"]


def _tallied(kind: int, lot: int, buckets: np.ndarray, counts: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted ``buckets`` by segment; counts stop at ``least``, which is all that is asked of them."""
    if not len(buckets):
        return
    small = np.minimum(counts, least).astype(np.min_scalar_type(least))
    buckets = buckets.astype(np.int64)
    segment = buckets >> SEGMENT
    first = np.flatnonzero(np.diff(segment, prepend=-1))
    low = (buckets & ((1 << SEGMENT) - 1)).astype("<u2")
    ends = [*first[1:], len(buckets)]
    n = len(first)
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()) for x in (low, small)]
    whole = [np.full(n, kind, np.int32), segment[first].astype(np.int32), np.full(n, lot, np.int32)]
    yield pa.RecordBatch.from_arrays([*map(pa.array, whole), *packed, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], TALLY_NAMES)


def _serialised(langs: pa.Array, names: pa.Array, lang: np.ndarray, paths: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(counts), ROWS):
        words = [names.take(pa.array(p[a : a + ROWS])) for p in paths]
        phrase = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, " ")
        n = counts[a : a + ROWS]
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[a : a + ROWS])), phrase, pa.array(np.full(len(n), len(paths), np.int32)), pa.array(n)], ["lang", "phrase", "d", "n"])


def tallies(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """Counts of words and pairs of ``docs`` (lang, text) in ``bits`` buckets, by shard and segment; words by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lot = Shard(), TaskContext.get().partitionId()  # lots only spread the work
        for batch in batches:
            for _ in shard.add(batch):
                yield from shard.tally(bits, least, lot)
                lot += 1
        yield from shard.tally(bits, least, lot)

    return docs.mapInArrow(run, TALLY)


def _added(rows: DataFrame, least: int, keys: list[str], bits: bool) -> DataFrame:
    """Rows of ``tallies`` with equal kind and segment added up as they stream by; ``keys`` deal them out.

    With ``bits``, (kind, segment, bits): which buckets reach ``least``.
    """
    dtype = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for kind, segment, places_, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "segment", "places", "counts"))):
                own = sums.setdefault((kind, segment), np.zeros(1 << SEGMENT, np.int64))
                own[np.frombuffer(places_, "<u2")] += np.frombuffer(counts, dtype)
        for (kind, segment), own in sums.items():
            if bits:
                packed = np.packbits(own >= least, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], ["kind", "segment", "bits"])
            else:
                at = np.flatnonzero(own)
                yield from _tallied(kind, 0, (segment << SEGMENT) + at, own[at], least)

    return rows.repartition(*keys).mapInArrow(run, "kind int, segment int, bits binary" if bits else TALLY)


def reaching(rows: DataFrame, bits: int, least: int, shares: int, kinds: tuple[int, ...] = (1, 2)) -> list[np.ndarray]:
    """Of a written table with rows as of ``tallies``, the buckets of each kind that reach ``least``, as bitmaps.

    At most ``MOST_BITS`` bits of each come to the driver.
    """
    rows = rows.filter("kind > 0").select(*TALLY_NAMES)
    if shares > 1:
        rows = _added(rows.withColumn("lot", F.pmod("lot", F.lit(shares))), least, ["kind", "segment", "lot"], False)
        rows = materialize(rows, "tally-shares")  # a task has one Python worker
    out = {k: np.zeros(bits // 8, np.uint8) for k in kinds}
    size = 1 << SEGMENT - 3
    for r in _added(rows, least, ["kind", "segment"], True).collect():
        out[r.kind][r.segment * size : (r.segment + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return [out[k] for k in kinds]


def _merged_here(runs: Iterator[pa.RecordBatch], ranges: int, most: int = MERGE) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's runs with equal paths added up; at most about ``most`` rows are held. Tallies pass."""
    held: list[pa.RecordBatch] = []
    for batch in runs:
        if "phrase" not in batch.schema.names:
            yield batch
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            held = _sums(held).to_batches()
            if sum(b.num_rows for b in held) >= most // 2:
                yield from _blocked(pa.Table.from_batches(held), ranges)
                held = []
    if held:
        yield from _blocked(_sums(held), ranges)


def _sums(batches: list[pa.RecordBatch]) -> pa.Table:
    table = pa.Table.from_batches(batches).group_by(["lang", "phrase", "d"]).aggregate([("n", "sum")])
    return table.rename_columns(["lang", "phrase", "d", "n"]).sort_by([("lang", "ascending"), ("phrase", "ascending")])


def _blocked(table: pa.Table, ranges: int) -> Iterator[pa.RecordBatch]:
    """Packed blocks of the rows, sorted as they are, by a range of the hash of the first word."""
    first = pc.list_element(pc.split_pattern(table.column("phrase"), " ", max_splits=1), 0).combine_chunks()
    at = (hashed(first) >> np.uint64(40)).astype(np.int64) % ranges
    order = np.argsort(at, kind="stable")
    table, at = table.take(pa.array(order)).combine_chunks(), at[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    for i in range(0, len(starts), 256):
        packed = []
        for a, b in zip(starts[i : i + 256], [*starts[1:], len(at)][i : i + 256]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(table.slice(a, b - a))
            packed.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(at[starts[i : i + 256]].astype(np.int32)), pa.array(packed, pa.binary())], ["range", "block"])


def _mixed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of either kind with all columns of ``MIXED``."""
    kinds = {"kind": pa.int32(), "segment": pa.int32(), "lot": pa.int32(), "places": pa.binary(), "counts": pa.binary(), "lang": pa.string(), "n": pa.int64(), "range": pa.int32(), "block": pa.binary()}
    own = set(batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column(c) if c in own else pa.nulls(batch.num_rows, kind) for c, kind in kinds.items()], list(kinds))


def pair_runs(docs: DataFrame, least: int, words_reach: np.ndarray, pairs_reach: np.ndarray, ranges: int = 64) -> DataFrame:
    """Rows of ``MIXED``: sorted blocks of words and pairs of ``docs`` (lang, text), those of a task merged, and tallies of longer phrases."""

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lot = Shard(), TaskContext.get().partitionId()
        for batch in batches:
            for _ in shard.add(batch):
                yield from shard.runs(least, words_reach, pairs_reach, lot)
                lot += 1
        yield from shard.runs(least, words_reach, pairs_reach, lot)

    return docs.mapInArrow(lambda batches: map(_mixed, _merged_here(tries(batches), ranges)), MIXED)


def deep_runs(docs: DataFrame, pair: np.ndarray, longer_reach: list[np.ndarray], ranges: int = 64) -> DataFrame:
    """Rows of ``RUNS``: the sorted runs of three words and more, those of a task merged."""

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for _ in shard.add(batch):
                yield from shard.deep(pair, longer_reach)
        yield from shard.deep(pair, longer_reach)

    return docs.mapInArrow(lambda batches: _merged_here(tries(batches), ranges), RUNS)


def merged(runs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, d, n) of the paths that occur ``least`` times in the written blocks ``runs`` (range, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            for at, block in zip(batch.column("range").to_pylist(), batch.column("block")):
                own = held.setdefault(at, [])
                own += pa.ipc.open_stream(block.as_buffer()).read_all().to_batches()
                if sum(b.num_rows for b in own) > 2 * sizes.get(at, ROWS):
                    held[at] = _sums(own).to_batches()
                    sizes[at] = max(ROWS, sum(b.num_rows for b in held[at]))
        for own in held.values():
            table = _sums(own)
            yield from table.filter(pc.greater_equal(table.column("n"), least)).to_batches(ROWS)

    return runs.select("range", "block").repartition("range").mapInArrow(run, NODES)


def bloom(nodes: DataFrame) -> np.ndarray:
    """A filter of the phrases in the written table ``nodes`` (lang, phrase), built where they are.

    At most ``MOST_BITS`` bits come to the driver, in segments.
    """
    bits = 1 << 15
    while bits < min(MOST_BITS, 16 * nodes.count()):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = pc.split_pattern(batch.column(1), " ")
                depth = int(pc.max(pc.list_value_length(words)).as_py())
                at = places(_phrase_hashes(batch.column(0), [pc.list_element(words, i) for i in range(depth)]), bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(at)).astype(np.int64) + 1)], ["at"])

    spots = nodes.select("lang", "phrase").mapInArrow(run, "at long")
    parts = spots.groupBy(F.expr("bitmap_bucket_number(at)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """Written tables (lang, phrase, n) of the nodes of each depth that occur ``least`` times, and (lang, total) of all words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 1 << SEGMENT
    while bits < min(MOST_BITS, size // BYTES):
        bits *= 2
    tally = materialize(tallies(docs, bits, least), "tallies")
    totals = materialize(tally.filter("kind = 0").groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
    shares = -(-size // SHARE)
    words, pairs = reaching(tally, bits, least, shares)
    discard(tally)
    ranges = max(64, bits >> SEGMENT)
    runs = materialize(pair_runs(docs, least, words, pairs, ranges), "runs")
    nodes = materialize(merged(runs.filter("block is not null"), least), "nodes")
    longer = reaching(runs, bits, least, shares, tuple(range(3, DEPTH + 1)))
    discard(runs)
    levels = [nodes.filter(F.col("d") == d).select("lang", "phrase", "n") for d in (1, 2)]
    runs = materialize(deep_runs(docs, bloom(levels[1]), longer, ranges), "deep-runs")
    deep = materialize(merged(runs, least), "deep-nodes")
    discard(runs)
    return [*levels, *[deep.filter(F.col("d") == d).select("lang", "phrase", "n") for d in range(3, DEPTH + 1)]], totals


def _linked(levels: list[DataFrame]) -> list[DataFrame]:
    """The nodes of two words and more with ``left`` and ``right``: counts of the parts before and after each cut.

    A node's left parts are its parent's and the parent itself; its right parts are those of its suffix
    link behind the link itself.
    """
    none = F.array().cast("array<long>")
    last = levels[0].select("lang", "phrase", "n", none.alias("left"), none.alias("right"))
    out = []
    for nodes in levels[1:]:
        up = nodes.select("lang", "phrase", "n", F.regexp_replace("phrase", " [^ ]*$", "").alias("parent"), F.regexp_replace("phrase", "^[^ ]* ", "").alias("suffix"))
        parent = last.select("lang", F.col("phrase").alias("parent"), F.concat("left", F.array("n")).alias("left"))
        suffix = last.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("n"), "right").alias("right"))
        last = materialize(up.join(parent, ["lang", "parent"]).join(suffix, ["lang", "suffix"]).select("lang", "phrase", "n", "left", "right", "parent", "suffix"), "linked")
        out.append(last)
    return out


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    levels, totals = frequent(rows, least)
    linked = _linked(levels)
    nodes = functools.reduce(DataFrame.unionByName, [x.select("lang", "phrase", "n", "left", "right") for x in linked])
    longer = [x.select("lang", F.col(side).alias("phrase"), "n") for x in linked[1:] for side in ("parent", "suffix")]
    longer = materialize(functools.reduce(DataFrame.unionByName, longer).groupBy("lang", "phrase").agg(F.max("n").alias("most")), "longer")
    open_ = nodes.join(longer, ["lang", "phrase"], "left").filter("most is null or most < n").drop("most")
    wide = lambda c: c.cast("decimal(19,0)")
    scored = open_.join(totals, "lang").withColumn("__an", (wide(F.col("n")) * wide(F.col("total"))).cast("decimal(35,0)"))
    # a score is at most total / least * 1000 and so fits a long
    cut = "transform(sequence(1, size(left)), k -> struct(cast((__an * 1000) div (cast(left[k - 1] as decimal(19,0)) * cast(right[k - 1] as decimal(19,0))) as bigint) as score, k as k, left[k - 1] as l, right[k - 1] as r))"
    best = scored.withColumn("cut", F.expr(f"array_min({cut})")).select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    first = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    # at most PARTS * top rows of a language
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, top: int = TOP) -> str:
    """DuckDB SQL for ``collocations`` over ``documents``."""
    grams = " UNION ALL ".join(f"SELECT lang, {d} AS d, unnest(list_transform(range(1, len(w) - {d - 2}), lambda i: w[i : i + {d - 1}])) AS p FROM w WHERE len(w) >= {d}" for d in range(1, DEPTH + 1))
    return f"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents),
        w AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM t),
        g AS ({grams}),
        f AS (SELECT lang, d, p, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE d = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE d > 1 AND f >= {least}),
        o AS (SELECT DISTINCT lang, x AS p FROM (SELECT lang, f, d, unnest(flatten(list_transform(range(2, d), lambda k: list_transform(range(1, d - k + 2), lambda i: p[i : i + k - 1])))) AS x FROM c) y
            WHERE EXISTS (FROM f WHERE f.lang = y.lang AND f.p = y.x AND 100 * y.f >= 100 * f.f)),
        k AS (SELECT lang, p, f, d, unnest(range(1, d)) AS k FROM c ANTI JOIN o USING (lang, p)),
        s AS (SELECT k.lang, k.p, k.f AS a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * k.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM k JOIN n ON n.lang = k.lang JOIN f l ON l.lang = k.lang AND l.p = k.p[1 : k.k] JOIN f r ON r.lang = k.lang AND r.p = k.p[k.k + 1 : k.d]),
        m AS (SELECT lang, p, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS c, any_value(a) AS a, any_value(n) AS n FROM s GROUP BY lang, p),
        z AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, c.l AS l, c.r AS r, n, c.score AS score FROM m)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank <= {top}"""
