"""Near-duplicate classes by a chosen-path similarity join of word-shingle sets.

A document's set is its distinct word shingles. Documents with equal sets are one representative.
Each representative has ``COORDINATES`` min-wise tokens; ``TREES`` independent trees each start with
``BRANCHES`` of them, and every node of a tree holds the representatives that agree on the tokens
chosen on the way to it. A node of at most ``MOST_ROWS`` representatives is compared exhaustively; a
larger one branches again by ``BRANCHES`` tokens that a hash of its path chooses, unless most of its
members agree there too: branching would only copy such a dense node. A pair at similarity 0.8 misses all
roots with probability 0.2 ** (TREES * BRANCHES), 1e-7, and fails the agreement below with 4e-6.

Exhaustive comparison is in two steps. Agreement of min-wise tokens splits a node into clusters, which
are the same in most trees and are kept once; the full sets of a cluster's members are then read from
the texts, and links are confirmed by exact counts. A link whose ends are joined already is not
counted, so a cluster of m members gives at most m - 1 links and no pairs of copies are ever listed.

A dense node of at most ``MOST_BLOCKED`` members is compared in pairs of blocks. In a larger one ``PIVOTS``
members are compared with all others first, exactly, which joins most of it in one component without a pair
of other members being looked at. Further rounds take their pivots from what is left, until that fits in a
block, hardly shrinks or ``PIVOT_ROUNDS`` are over. What is left then is compared with the whole node, in
blocks; only pairs inside the component, which can't join anything, are left out.

Results in special cases: null or empty text, and text without words, has an empty set and is linked
with nothing; fewer words than a shingle are one shingle; a null doc_id links like others but its
class is the smallest id that isn't null, or null where all are; rows with equal doc_id and different
texts link apart; an empty table gives an empty result; further columns are ignored by ``classes``.
``keep_one`` keeps rows that share the first id and text of a class, and of a class without ids the row
whose columns come first as JSON text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm import bytehash
from ragweave.llm.common import connected_components, discard, first_as_json, free_name, materialize, ragged, row_blocks, text_views

COORDINATES, TREES, BRANCHES = 64, 5, 2
#: Representatives, and shingles of all their sets, that one task compares at once.
MOST_ROWS, MOST_SHINGLES = 2048, 1 << 22
#: Members of a dense node above which pivots come before blocks: up to there a member is in 16 pairs of blocks.
MOST_BLOCKED = 8 * MOST_ROWS
#: Members of a dense node that all others are compared with in a round, and rounds of that.
PIVOTS, PIVOT_ROUNDS = 8, 4
#: Share of what was left before a round above which the next one isn't worth it.
SHRINK = 0.7
#: Rounds of branching, and the share of a node in one child that makes it dense.
ROUNDS, DENSE = 4, 0.7
#: Similarity asked for, in per cent, and the agreement of tokens below which a pair is out.
SIMILARITY, AGREEMENT = 80, 36
BLOCK = 1 << 20

_MULTIPLIERS = bytehash.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within a row, and their numbers."""
    words, counts = bytehash.word_hashes(data, offsets)
    runs, sizes = bytehash.shingles(words, counts, k)
    ends = np.cumsum(sizes)
    parts = [np.unique(runs[e - n : e]) for e, n in zip(ends, sizes)]
    return np.concatenate(parts) if parts else runs, np.array([len(p) for p in parts], np.int64)


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(rows, COORDINATES) min-wise tokens; rows with empty sets get zeros."""
    out = np.zeros((len(sizes), COORDINATES), np.uint32)
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        for j, by in enumerate(_MULTIPLIERS):
            out[some, j] = np.minimum.reduceat(sets * by, starts) >> np.uint64(32)
    return out


def _node(path: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return bytehash.mix(path * np.uint64(0x9FB21C651E98DF25) + bytehash.mix(at.astype(np.uint64) + np.uint64(1)) + value.astype(np.uint64))


def roots(tokens: np.ndarray) -> np.ndarray:
    """(rows, TREES * BRANCHES) first nodes of each row."""
    at = np.arange(TREES * BRANCHES)
    return _node((at // BRANCHES).astype(np.uint64)[None, :], at[None, :], tokens[:, at])


def children(path: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """(rows, BRANCHES) nodes that rows at ``path`` go to."""
    out = np.empty((len(path), BRANCHES), np.uint64)
    for b in range(BRANCHES):
        at = (bytehash.mix(path + np.uint64(b + 1)) >> np.uint64(20)) % np.uint64(COORDINATES)
        out[:, b] = _node(path, at, tokens[np.arange(len(path)), at.astype(np.int64)])
    return out


SKETCH = "doc_id long, mark long, n_shingles long, set_a long, set_b long, nodes array<long>, tokens binary"


def _mark(text: str) -> F.Column:
    return F.xxhash64(text)


def sketch(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Text hash (mark), set size, set fingerprint, root nodes and min-wise tokens of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(1))
            ids, marks = batch.column(0).cast(pa.int64()), batch.column(2)
            for a, b in row_blocks(offsets, BLOCK):
                sets, sizes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                mixed = bytehash.mix(sets)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (sets, mixed)]
                ends = np.cumsum(sizes)
                seals = [(s[ends] - s[ends - sizes]).view(np.int64) for s in sums]
                tokens = signatures(sets, sizes)
                nodes = roots(tokens).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        marks.slice(a, b - a),
                        pa.array(sizes),
                        pa.array(seals[0]),
                        pa.array(seals[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * nodes.shape[1]), pa.array(nodes.reshape(-1))),
                        pa.array([x.tobytes() for x in tokens], pa.binary()),
                    ],
                    ["doc_id", "mark", "n_shingles", "set_a", "set_b", "nodes", "tokens"],
                )

    return docs.select(id_col, text_col, _mark(text_col)).mapInArrow(run, SKETCH)


def _branch(rows: DataFrame) -> DataFrame:
    """(parent, choice, node, rep, n_shingles, tokens) of rows (node, rep, n_shingles, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            parent = batch.column("node")
            found = children(parent.to_numpy().view(np.uint64), tokens).view(np.int64)
            for b in range(BRANCHES):
                yield pa.RecordBatch.from_arrays([parent, pa.array(np.full(len(found), b, np.int32)), pa.array(found[:, b]), *(batch.column(c) for c in ("rep", "n_shingles", "tokens"))], ["parent", "choice", "node", "rep", "n_shingles", "tokens"])

    return rows.select("node", "rep", "n_shingles", "tokens").mapInArrow(run, "parent long, choice int, node long, rep long, n_shingles long, tokens binary")


def split_by_tokens(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cluster of each row: reachable by pairs that agree on ``AGREEMENT`` tokens and fit in size."""
    n = len(tokens)
    label = np.full(n, -1)
    step = max(1, (1 << 24) // max(1, n * COORDINATES))
    left, cluster = np.arange(n), 0
    while len(left):
        front, left = left[:1], left[1:]
        label[front] = cluster
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for a in range(0, len(front), step):
                f = front[a : a + step]
                agree = (tokens[f][:, None, :] == tokens[left][None, :, :]).sum(2) >= AGREEMENT
                small, large = np.minimum(sizes[f][:, None], sizes[left][None, :]), np.maximum(sizes[f][:, None], sizes[left][None, :])
                near |= (agree & (100 * small >= SIMILARITY * large)).any(0)
            front, left = left[near], left[~near]
            label[front] = cluster
        cluster += 1
    return label


def _clusters(groups: DataFrame) -> DataFrame:
    """Distinct (members) of two at least, of groups (key, rows: array<struct<rep, n_shingles, tokens>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                rows = batch.column(0)[i].values
                reps, sizes = rows.field("rep").to_numpy(), rows.field("n_shingles").to_numpy()
                order = np.argsort(reps, kind="stable")
                tokens = np.frombuffer(b"".join(rows.field("tokens").to_pylist()), np.uint32).reshape(-1, COORDINATES)[order]
                label = split_by_tokens(tokens, sizes[order])
                for c in range(label.max() + 1):
                    own = np.unique(reps[order[label == c]])
                    if len(own) > 1:
                        out.append(own)
            if out:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))], ["members"])

    return groups.select("rows").mapInArrow(run, "members array<long>").distinct()


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Exact links between sets (sorted hashes) that join what no earlier link has joined."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(values), np.int32)
    part = np.arange(len(sets))
    out = []
    for p in range(len(sets) - 1):
        last = int(np.searchsorted(sizes, 100 * sizes[p] // SIMILARITY, "right"))
        rest = p + 1 + np.flatnonzero(part[p + 1 : last] != part[p])
        if not len(rest):
            continue
        own = flat[starts[p] : starts[p] + sizes[p]]
        mark[own] = 1
        members = flat[ragged(starts[rest], sizes[rest])] if len(rest) < last - p - 1 else flat[starts[p + 1] : starts[last - 1] + sizes[last - 1]]
        common = np.add.reduceat(mark[members], np.cumsum(sizes[rest]) - sizes[rest])
        mark[own] = 0
        for q in rest[100 * common >= SIMILARITY * (sizes[p] + sizes[rest] - common)]:
            if part[q] != part[p]:
                out.append((order[p], order[q]))
                part[part == part[q]] = part[p]
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, shingles) with the packed sets of the representatives in ``wanted`` (rep, seal, id, mark).

    A representative's text is found by id and text hash, so null and repeated ids are found too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(2))
            reps, seals = batch.column(0), batch.column(1).to_numpy()
            for a, b in row_blocks(offsets, BLOCK):
                sets, sizes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                ends = np.cumsum(sizes)
                rows = [(i, sets[e - n : e]) for i, e, n in zip(range(a, b), ends, sizes)]
                rows = [(i, s) for i, s in rows if np.sum(s, dtype=np.uint64).view(np.int64) == seals[i]]
                yield pa.RecordBatch.from_arrays([reps.take(pa.array([i for i, _ in rows], pa.int64())), pa.array([s.tobytes() for _, s in rows], pa.binary())], ["rep", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("own"), _mark(text_col).alias("own_mark"), F.col(text_col).alias("text"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark"))
    return texts.join(wanted, same).select("rep", "seal", "text").mapInArrow(run, "rep long, shingles binary").dropDuplicates(["rep"])


def _links(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) links of clusters (cluster, members), confirmed on full sets."""

    def run(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_numpy()
        found = forest([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()])
        u, v = (np.array([reps[x[i]] for x in found], np.int64) for i in (0, 1))
        return pa.table({"u": u, "v": v})

    rows = clusters.select("cluster", F.explode("members").alias("rep")).join(sets, "rep")
    return rows.groupBy("cluster").applyInArrow(run, "u long, v long")


def _leaf_groups(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(rows) of the nodes in ``counts``, each gathered; the counts bound their size."""
    kept = rows.join(counts.select("node"), "node").dropDuplicates(["node", "rep"])
    return kept.groupBy("node").agg(F.collect_list(F.struct("rep", "n_shingles", "tokens")).alias("rows"))


def agreeing(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v) of rows (u, v, n_u, n_v, tokens_u, tokens_v) whose tokens and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in ("tokens_u", "tokens_v"))
            x, y = (batch.column(c).to_numpy() for c in ("n_u", "n_v"))
            fit = ((a == b).sum(1) >= AGREEMENT) & (100 * np.minimum(x, y) >= SIMILARITY * np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(fit)) for c in ("u", "v")], ["u", "v"])

    return pairs.select("u", "v", "n_u", "n_v", "tokens_u", "tokens_v").mapInArrow(run, "u long, v long").distinct()


def confirmed(pairs: DataFrame) -> DataFrame:
    """The (u, v) of rows (u, v, set_u, set_v) that are as similar as asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = []
            for x, y in zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                fit.append(100 * common >= SIMILARITY * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(fit, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    return pairs.select("u", "v", "set_u", "set_v").mapInArrow(run, "u long, v long")


def _pivot_links(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact links (u, v) of dense nodes by pivots, and (node, rep) of what they leave outside the component.

    ``rows``: (node, rep, n_shingles, tokens) of the nodes; ``sets``: (rep, shingles) of their members.
    Both are written tables.
    """
    links = None
    left, n_left = rows.select("node", "rep"), rows.count()
    for number in range(PIVOT_ROUNDS):
        chosen = [F.min_by("rep", F.xxhash64("rep", F.lit(number * PIVOTS + j))) for j in range(PIVOTS)]
        pivots = left.groupBy("node").agg(F.array(*chosen).alias("u")).select("node", F.explode(F.array_distinct("u")).alias("u"))
        own = rows.select(F.col("rep").alias("u"), F.col("n_shingles").alias("n_u"), F.col("tokens").alias("tokens_u")).dropDuplicates(["u"])
        pivots = materialize(pivots.join(own, "u"), "pivots")
        pairs = rows.join(pivots, "node").filter("rep <> u").withColumnsRenamed({"rep": "v", "n_shingles": "n_v", "tokens": "tokens_v"})
        pairs = materialize(agreeing(pairs), "pivot-pairs")
        ends = [sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("u", "v")]
        ends[0] = materialize(ends[0].join(pivots.select("u").distinct(), "u", "left_semi"), "pivot-sets")
        new = materialize(confirmed(pairs.join(ends[0], "u").join(ends[1], "v")), "pivot-links")
        links = new if links is None else links.unionByName(new)
        parts = materialize(connected_components(links, "pivot-parts").groupBy("node").agg(F.min("component").alias("part")).withColumnRenamed("node", "rep"), "pivot-members")
        labelled = rows.select("node", "rep").join(parts, "rep", "left").select("node", "rep", F.coalesce("part", "rep").alias("part"))
        main = labelled.groupBy("node", "part").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
        left = materialize(labelled.join(main, "node").filter("part <> main").select("node", "rep"), "outside")
        n_before, (n_left, most) = n_left, left.groupBy("node").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        if most <= MOST_ROWS // 2 or n_left > SHRINK * n_before:
            break
    return links, left


def _block_groups(rows: DataFrame, left: DataFrame) -> DataFrame:
    """(rows) of pairs of blocks of dense nodes: of what is ``left`` (node, rep) with itself and with the rest."""
    tagged = rows.join(left.withColumn("out", F.lit(True)), ["node", "rep"], "left").withColumn("out", F.coalesce("out", F.lit(False)))
    blocks = lambda which: F.ceil(F.greatest(F.count(F.when(which, 1)) * 2 / MOST_ROWS, F.coalesce(F.sum(F.when(which, F.col("n_shingles"))), F.lit(0)) * 2 / MOST_SHINGLES)).cast("int")
    sizes = materialize(tagged.groupBy("node").agg(blocks(F.col("out")).alias("outer"), blocks(~F.col("out")).alias("inner")).filter(F.col("outer") > 0), "blocks")
    sized = tagged.join(sizes, "node")
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at = F.pmod(F.xxhash64("rep"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))).cast("int")
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    among = F.transform(to(F.col("outer")), lambda j: pair(0, F.least(F.col("at"), j), F.greatest(F.col("at"), j)))
    across = F.transform(to(F.col("inner")), lambda j: pair(1, F.col("at"), j))
    inside = F.transform(to(F.col("outer")), lambda i: pair(1, i, F.col("at")))
    dealt = sized.withColumn("at", at).withColumn("pair", F.explode(F.when(F.col("out"), F.concat(among, across)).otherwise(inside)))
    return dealt.groupBy("node", "pair").agg(F.collect_list(F.struct("rep", "n_shingles", "tokens")).alias("rows"))


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Distinct (members) that hold the pairs that small nodes bring together, and (node, rep, n_shingles, tokens) of dense ones."""
    thin = reps.select("rep", F.explode("nodes").alias("node"), "n_shingles")
    stats = [F.count("*").alias("n"), F.sum("n_shingles").alias("weight")]
    is_leaf = f"n <= {MOST_ROWS} and weight <= {MOST_SHINGLES}"
    counts = materialize(thin.groupBy("node").agg(*stats).filter("n > 1"), "nodes")
    full = thin.drop("n_shingles").join(counts.select("node"), "node").join(reps.select("rep", "n_shingles", "tokens"), "rep")
    rows = materialize(full.select("node", "rep", "n_shingles", "tokens"), "node-rows")
    found = _clusters(_leaf_groups(rows, counts.filter(is_leaf)))
    large = counts.filter(f"not ({is_leaf})")
    dense_rows: list[DataFrame] = []
    for _ in range(ROUNDS):
        if large.isEmpty():
            break
        held = materialize(rows.join(large.select("node"), "node"), "large-nodes")
        below = materialize(_branch(held), "branches")
        sizes = below.groupBy("parent", "choice", "node").agg(*stats)
        shares = sizes.groupBy("parent").agg(F.max("n").alias("most")).join(large.withColumnRenamed("node", "parent"), "parent")
        dense = materialize(shares.filter(F.col("most") > DENSE * F.col("n")).select(F.col("parent").alias("node")), "dense")
        dense_rows.append(held.join(dense, "node"))
        rows = materialize(below.join(dense.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node", "rep", "n_shingles", "tokens"), "node-rows")
        discard(below)
        counts = materialize(rows.groupBy("node").agg(*stats).filter("n > 1"), "nodes")
        found = found.unionByName(_clusters(_leaf_groups(rows, counts.filter(is_leaf))))
        large = counts.filter(f"not ({is_leaf})")
    else:
        dense_rows.append(rows.join(large.select("node"), "node"))
    if not dense_rows:
        return found.distinct(), None
    return found.distinct(), materialize(functools.reduce(DataFrame.unionByName, dense_rows).dropDuplicates(["node", "rep"]), "dense-rows")


def _classes(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, and (first_id, first_mark): the class's first row, null ids last.

    A representative is a distinct set under a written row number, so ids may be null or repeated.
    """
    drawn = materialize(sketch(docs, k, id_col, text_col), "sketches")
    key = ["set_a", "set_b", "n_shingles"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "mark"))
    reps = drawn.filter("n_shingles > 0").groupBy(*key).agg(first.alias("first"), F.first("nodes").alias("nodes"), F.first("tokens").alias("tokens"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    found, dense = candidates(reps)
    sources = reps.select("rep", F.col("set_a").alias("seal"), "first.id", "first.mark")
    sets_of = lambda wanted: materialize(_sets_of(docs, wanted.select("rep").distinct().join(sources, "rep"), k, id_col, text_col), "sets")
    by_pivots = None
    if dense is not None and not dense.isEmpty():
        sizes = materialize(dense.groupBy("node").agg((F.count("*") > MOST_BLOCKED).alias("large")), "dense-sizes")
        left = dense.join(sizes.filter("not large").select("node"), "node").select("node", "rep")
        large = dense.join(sizes.filter("large").select("node"), "node")
        if not large.isEmpty():
            large = materialize(large, "dense-large")
            sets = sets_of(large)
            by_pivots, outside = _pivot_links(large, sets)
            discard(sets)
            left = left.unionByName(outside)
        found = found.unionByName(_clusters(_block_groups(dense, left))).distinct()
    found = materialize(found.withColumn("cluster", F.xxhash64("members")), "clusters")
    sets = sets_of(found.select(F.explode("members").alias("rep")))
    links = materialize(_links(found, sets), "links")
    discard(sets)
    links = links if by_pivots is None else links.unionByName(by_pivots)
    parts = connected_components(links, "parts").groupBy("node").agg(F.min("component").alias("component"))
    parts = materialize(parts.join(reps.select(F.col("rep").alias("node"), "first"), "node"), "members")
    firsts = materialize(parts.groupBy("component").agg(F.min("first").alias("class_first")), "firsts")
    joined = parts.join(firsts, "component").select("node", "class_first")
    named = reps.select(*key, "rep", "first").join(joined, reps["rep"] == joined["node"], "left").select(*key, F.coalesce("class_first", "first").alias("first"))
    out = drawn.select("doc_id", "mark", *key).join(named, key, "left")
    lone = F.col("first").isNull()
    return out.select("doc_id", "mark", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("first.id")).alias("component_id"), *[F.when(lone, F.col(own)).otherwise(F.col(f"first.{x}")).alias(f"first_{x}") for x, own in (("id", "doc_id"), ("mark", "mark"))])


def classes(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; kept are the rows that ``keep_one`` chooses from."""
    found = _classes(docs, k, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id", _is_first().alias("kept"))


def _is_first() -> F.Column:
    return F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))


def keep_one(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but the smallest doc_id of each class; all columns stay.

    Rows go by id and text hash. Equal rows of a class without any id, if there are any, are joined and
    reduced to one apart from the others.
    """
    mark, other, other_mark, kept = (free_name(docs, x) for x in ("mark", "gone", "gone_mark", "gone_kept"))
    found = _classes(docs, k, id_col, text_col).withColumn("kept", _is_first())
    found = found.filter("not kept or (doc_id is null and n_shingles > 0)").groupBy("doc_id", "mark", "kept").agg(F.count("*").alias("n")).filter("not kept or n > 1")
    found = materialize(found.select(F.col("doc_id").alias(other), F.col("mark").alias(other_mark), F.col("kept").alias(kept)), "gone")
    tagged = docs.withColumn(mark, _mark(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(other)) & (F.col(mark) == F.col(other_mark))
    once = tagged.join(found, same, "left_anti")
    if found.filter(F.col(kept)).isEmpty():  # no row without an id repeats another
        return once.drop(mark)
    repeated = first_as_json(tagged.join(found.filter(F.col(kept)), same, "left_semi"), [mark])
    return once.unionByName(repeated).drop(mark)
