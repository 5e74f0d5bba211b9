"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` ids; full pieces are sequences of their own. The others
are dealt to shards of about ``SHARD`` pieces by a hash of their row. Inside a shard pieces of equal
length are interchangeable, so a shard's problem is its histogram of lengths, which is bounded by the
capacity. Every shard is solved by ``ISLANDS`` islands, each with its own population, which starts from
groupings in random order. A child takes whole well-filled bins of one parent, then those of the other
that hold no piece it has already, and the displaced lengths by best fit, longest first. Well-filled is the
``INJECTED`` share of a parent's bins: the fullest, and of those with the fewest pieces, so that short
pieces are left to fill gaps. After each of ``EPOCHS`` epochs the best solution of an island is written
out and migrates to the next island; an island stops once it needs no more bins than the sum of lengths
does. The best island's solution is dealt to the pieces; bins below ``WELL_FILLED`` are dissolved and
their pieces go to the next tier, with a fraction of the shards, until one shard is left or most pieces'
bins stay as they were.

Results in special cases: null or empty text is the end id alone; rows that repeat a document are packed
each; an empty table gives no pieces; further columns are ignored; a capacity below 1 is an error.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm import tokens
from ragweave.llm.common import discard, materialize, ragged, row_blocks, text_views

CAPACITY, SHARD, ISLANDS, EPOCHS = 2048, 20_000, 2, 2
#: Solutions on an island, children in an epoch, share of a parent's bins that crossover takes from.
POPULATION, CHILDREN, INJECTED = 3, 4, 0.2
WELL_FILLED = 0.97
#: Tasks that islands are dealt to at most.
MOST_TASKS = 20_000
#: Bytes of texts that are encoded at once.
BLOCK = 1 << 22

Bins = list[list[int]]


def best_fit(items: list[int], bins: Bins, capacity: int) -> Bins:
    """``bins`` and ``items``, in their order, each in the fullest bin that has room for it."""
    room: list[Bins] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for b in bins:
        r = capacity - sum(b)
        room[r].append(b)
        open_rooms |= 1 << r
    for x in items:
        fits = open_rooms >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            b, r = [], capacity
        b.append(x)
        r -= x
        room[r].append(b)
        open_rooms |= 1 << r
    return [b for same in room for b in same]


def fitness(bins: Bins, capacity: int) -> tuple[int, int]:
    """Fewer bins first; then fuller ones, by the sum of squares."""
    return -len(bins), sum(sum(b) ** 2 for b in bins)


def well_filled(bins: Bins) -> Bins:
    """The ``INJECTED`` share of ``bins``: the fullest, those of fewer pieces first."""
    return sorted(bins, key=lambda b: (sum(b), -len(b)), reverse=True)[: max(1, int(len(bins) * INJECTED))]


def crossover(a: Bins, b: Bins, lengths: Counter, capacity: int, chance: random.Random) -> Bins:
    """About half the well-filled bins of ``b``, those of ``a`` without a piece of these, the rest by best fit."""
    child = [bin_ for bin_ in well_filled(b) if chance.random() < 0.5]
    left = Counter(lengths)
    for bin_ in child:
        left.subtract(bin_)
    for bin_ in well_filled(a):
        need = Counter(bin_)
        if all(left[x] >= n for x, n in need.items()):
            left.subtract(need)
            child.append(bin_)
    displaced = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
    full = [bin_ for bin_ in child if sum(bin_) == capacity]
    return full + best_fit(displaced, [list(bin_) for bin_ in child if sum(bin_) < capacity], capacity)


class Elite(NamedTuple):
    """The best solution of an island after an epoch, whether crossover made it, and the children of the epoch."""

    bins: Bins
    is_child: bool
    children: int


def evolve(lengths: Counter, capacity: int, seed: int, migrants: list[Bins]) -> Elite:
    """An epoch of an island. Without migrants, those of the epochs before, its population is new."""
    chance = random.Random(seed)
    items = sorted(lengths.elements())
    least = -(-sum(items) // capacity)
    score = lambda s: fitness(s[0], capacity)
    population = [(bins, True) for bins in migrants]
    while len(population) < POPULATION and min((len(s) for s, _ in population), default=least + 1) > least:
        chance.shuffle(items)
        population.append((best_fit(items, [], capacity), False))
    population.sort(key=score, reverse=True)
    children = 0
    while children < CHILDREN and len(population) > 1 and len(population[0][0]) > least:
        (a, _), (b, _) = chance.sample(population, 2)
        population.append((crossover(a, b, lengths, capacity, chance), True))
        population = sorted(population, key=score, reverse=True)[:POPULATION]
        children += 1
    return Elite(*population[0], children)


def pack_solution(bins: Bins) -> bytes:
    """Bins as 32-bit integers: of each its size, then its lengths."""
    return np.array([x for b in bins for x in (len(b), *b)], "<i4").tobytes()


def unpack_solution(packed: bytes) -> Bins:
    values, out, at = np.frombuffer(packed, "<i4").tolist(), [], 0
    while at < len(values):
        out.append(values[at + 1 : at + 1 + values[at]])
        at += 1 + values[at]
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids and the end id; only longer documents are cut."""
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.word_encoder(path)
        for batch in batches:
            _, offsets = text_views(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK):
                ids, ends = coder.encode_column(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4")
                ends = ends + np.arange(len(ends))
                counts = -(-np.diff(ends) // capacity)
                row = np.repeat(np.arange(b - a), counts)
                piece = ragged(np.zeros(b - a, np.int64), counts)
                start = piece * capacity
                first = ends[row] + start
                length = np.minimum(ends[row + 1] - first, capacity)
                crc = [zlib.crc32(ids[x : x + n]) for x, n in zip(first.tolist(), length.tolist())]
                doc = batch.column(0).slice(a, b - a).take(pa.array(row))
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


ELITES = "shard int, island int, bins int, squares double, solution binary"


def _epoch(problems: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """The elite of each (shard, island, lengths, solution), where ``solution`` lists those to start from."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for shard, island, lengths, start in zip(frame["shard"], frame["island"], frame["lengths"], frame["solutions"]):
                counts = Counter({int(x["length"]): int(x["n"]) for x in lengths})
                best = evolve(counts, capacity, 1_000_003 * shard + 1009 * island + epoch, [unpack_solution(bytes(s)) for s in start]).bins
                size, squares = fitness(best, capacity)
                out.append((shard, island, -size, float(squares), pack_solution(best)))
            yield pd.DataFrame(out, columns=["shard", "island", "bins", "squares", "solution"])

    return problems.mapInPandas(run, ELITES)


def solve(todo: DataFrame, capacity: int, shards: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(shard, solution): the best of all islands for each of ``shards`` shards of pieces (shard, length).

    Histograms are small and their evolution is long, so islands are dealt to as many tasks as there are
    islands, up to ``MOST_TASKS``.
    """
    lengths = todo.groupBy("shard", "length").agg(F.count("*").alias("n")).groupBy("shard").agg(F.collect_list(F.struct("length", "n")).alias("lengths"))
    problems = materialize(lengths.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))), "islands")
    start = problems.withColumn("solutions", F.expr("cast(array() as array<binary>)"))
    elites = None
    for epoch in range(epochs):
        last, elites = elites, materialize(_epoch(start.repartition(min(shards * islands, MOST_TASKS), "shard", "island"), capacity, epoch), "elites")
        if last is not None:
            discard(last)
        moved = elites.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "solution")
        both = elites.select("shard", "island", "solution").unionByName(moved).groupBy("shard", "island").agg(F.array_sort(F.collect_list("solution")).alias("solutions"))
        start = problems.join(both, ["shard", "island"])
    best = F.max_by("solution", F.struct(-F.col("bins"), "squares", -F.col("island")))
    return elites.groupBy("shard").agg(best.alias("solution"))


def _assign(todo: DataFrame, solved: DataFrame, capacity: int) -> DataFrame:
    """``todo`` with bin, offset and fill of each piece in its shard's solution."""
    fields = ["row", *[x.split()[0] for x in PIECES.split(", ")], "shard"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bins = unpack_solution(bytes(right["solution"].iloc[0]))
        sizes = np.array([len(b) for b in bins])
        flat = np.array([x for b in bins for x in b], np.int64)
        number = np.repeat(np.arange(len(bins)), sizes)
        ends = np.cumsum(flat)
        before = np.concatenate([[0], ends])[np.cumsum(sizes) - sizes]
        fill = np.add.reduceat(flat, np.cumsum(sizes) - sizes)
        place = np.argsort(flat, kind="stable")
        out = left.sort_values(["length", "row"], kind="stable")[fields].reset_index(drop=True)
        out["bin"] = number[place]
        out["offset"] = (ends - flat - before[number])[place]
        out["fill"] = fill[number[place]]
        return out

    return todo.groupBy("shard").cogroup(solved.groupBy("shard")).applyInPandas(run, f"row long, {PIECES}, shard int, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` with sequence_id and offset; sequences hold at most ``capacity`` ids, without gaps."""
    rows = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    columns = [x.split()[0] for x in PIECES.split(", ")]
    done = rows.filter(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = rows.filter(F.col("length") < capacity)
    n = todo.count()
    for tier in range(16):
        shards = max(1, round(n / shard))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(tier)), F.lit(shards)).cast("int"))
        placed = materialize(_assign(dealt, solve(dealt, capacity, shards), capacity), "placed")
        poor = placed.filter(F.col("fill") < WELL_FILLED * capacity)
        before, n = n, poor.count() if shards > 1 else 0
        last = shards == 1 or tier == 15 or 2 * n > before  # where most stay poor, another tier would only repeat this one
        name = F.lit(tier << 58) + F.col("shard").cast("long") * (1 << 26) + F.col("bin")
        ready = placed if last else placed.filter(F.col("fill") >= WELL_FILLED * capacity)
        done = done.unionByName(ready.select(*columns, name.alias("sequence_id"), "offset"))
        if last:
            return done
        todo = poor.select("row", *columns)
    return done
