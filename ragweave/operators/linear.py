"""Trained text scanners: a linear model over hashed words and word pairs, fitted by sums of gradients.

A text is the set of its lower-cased words and pairs of neighbours, hashed to ``DIMS`` places. A first pass counts the
texts of each label that have a place; places whose share differs between a label and the others by less than
``SURE`` standard errors, or that fewer than ``LEAST`` texts have, are left out, and a text's other places are scaled to
length 1. Each round reads all training rows: a task adds up its rows' gradient, one array of fixed size, the arrays meet
in a tree, and the driver takes a step on the model, which has that size too, scaled by the gradients so far. Rows aren't
sampled, and nothing else of them reaches the driver. A share of the rows set apart by a hash of the text sets the
temperature of the probabilities.

Results in special cases: rows whose label or text is null aren't learned from; a text that is null or has no words gets
the label that is most frequent, by the model's constant part; without labelled rows, or with one label, every text gets
null, or that label; ties go to the label first in order; rows that repeat count each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.storage import materialize, small_batches

#: Places of features, labels at most, rounds, step, penalty, and the tree's width.
DIMS, MOST_LABELS, ROUNDS, STEP, PENALTY, WIDTH = 1 << 16, 64, 30, 0.5, 1e-6, 16
#: Standard errors and texts that a place must have to be learned from.
SURE, LEAST = 4.0, 5
#: One text in so many sets the temperature instead of the weights.
APART = 8
TEMPERATURES = np.exp(np.linspace(np.log(0.05), np.log(4), 40))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (DIMS + 1, labels); the last row is the constant part
    used: np.ndarray  # which places count
    temperature: float = 1.0


def featured(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``features``: the distinct places of the words and pairs of neighbours of the text."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    held = rows.withColumn("__words", words)
    pairs = F.zip_with("__words", F.slice("__words", 2, F.greatest(F.size("__words") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    places = F.array_distinct(F.transform(F.concat("__words", pairs), lambda w: F.pmod(F.xxhash64(w), F.lit(DIMS)).cast("int")))
    return held.withColumn("features", places).drop("__words")


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many places each row has, and all of them, of a column of lists or of packed bytes."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        held = column.buffers()[2]
        return np.diff(ends) // 4, np.frombuffer(held, np.uint8)[ends[0] : ends[-1]].view("<i4") if held else np.zeros(0, "<i4")
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def _packed(rows: DataFrame, used: np.ndarray) -> DataFrame:
    """``rows`` (features, y) with only the ``used`` places, by their numbers among these, as packed bytes."""
    number = np.cumsum(used, dtype="<i4") - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = _places(batch.column("features"))
            keep = used[at]
            sizes = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
            ends = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(number[at[keep]].tobytes())])
            yield pa.RecordBatch.from_arrays([packed, batch.column("y")], ["features", "y"])

    return rows.select("features", "y").mapInArrow(run, "features binary, y int")


def _logits(batch: pa.RecordBatch, weights: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits of each row, and of its features the place and the row, and the rows' scale."""
    n, at = _places(batch.column("features"))
    row = np.repeat(np.arange(len(n)), n)
    if not used.all():
        keep = used[at]
        at, row = at[keep], row[keep]
    sizes = np.bincount(row, minlength=len(n))
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    out = np.tile(weights[-1].astype(float), (len(sizes), 1))
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] += np.add.reduceat(weights[at], starts, axis=0) * scale[some, None]
    return out, at, row, scale


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _summed(rows: DataFrame, shape: tuple[int, int], of: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, int]:
    """Sum of ``of`` over the batches of the rows, through a tree of ``WIDTH`` branches, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape), 0
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % WIDTH], pa.int32()), pa.array([n]), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["branch", "n", "sum"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for x in parts.column("sum"):
            total += np.frombuffer(x.as_buffer(), "<f8").reshape(shape)
        return pa.table({"n": pa.array([sum(parts.column("n").to_pylist())]), "sum": pa.array([total.tobytes()], pa.binary())})

    found = rows.mapInArrow(run, "branch int, n long, sum binary").groupBy("branch").applyInArrow(add, "n long, sum binary").collect()
    return sum((np.frombuffer(r["sum"], "<f8").reshape(shape) for r in found), np.zeros(shape)), sum(r.n for r in found)


def _counts(rows: DataFrame, labels: int) -> np.ndarray:
    """(DIMS + 1, labels): texts of each label that have a place, and texts of each label."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        column, y = batch.column("features"), batch.column("y").to_numpy()
        n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.bincount(at * labels + np.repeat(y, n), minlength=DIMS * labels).reshape(DIMS, labels)
        return np.vstack([flat, np.bincount(y, minlength=labels)[None]]).astype(float)

    return _summed(rows, (DIMS + 1, labels), of)[0]


def telling(counts: np.ndarray) -> np.ndarray:
    """Places whose share of texts differs surely between a label and the others."""
    has, own = counts[:-1], counts[-1]
    all_, total = has.sum(1, keepdims=True), own.sum()
    rest = np.maximum(total - own, 1)
    share = all_ / max(total, 1)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / np.maximum(own, 1) + 1 / rest))
    z = np.abs(has / np.maximum(own, 1) - (all_ - has) / rest) / error
    return (z.max(1) >= SURE) & (all_[:, 0] >= LEAST)


def _gradient(rows: DataFrame, weights: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of the gradients of the rows (features, y), and their number."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        logits, at, row, scale = _logits(batch, weights, used)
        gap = _softmax(logits)
        gap[np.arange(len(gap)), batch.column("y").to_numpy()] -= 1
        scaled = gap * scale[:, None]
        parts = [np.bincount(at, scaled[row, c], len(weights) - 1) for c in range(gap.shape[1])]
        return np.vstack([np.stack(parts, 1), gap.sum(0)[None]])

    return _summed(rows, weights.shape, of)


def _losses(rows: DataFrame, weights: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Summed log losses of the rows at each of ``TEMPERATURES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES))
        for batch in batches:
            if batch.num_rows:
                logits, y = _logits(batch, weights, used)[0], batch.column("y").to_numpy()
                for i, t in enumerate(TEMPERATURES):
                    total[i] -= np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "loss"])

    sums = rows.mapInArrow(run, "i long, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    out = np.zeros(len(TEMPERATURES))
    for r in sums:
        out[r.i] = r.loss
    return out


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "label", rounds: int = ROUNDS) -> Model:
    """A model of the labelled texts; at most ``MOST_LABELS`` labels."""
    small_batches(rows.sparkSession)
    known = rows.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).filter("text is not null and label is not null")
    labels = sorted(r.label for r in known.select("label").distinct().limit(MOST_LABELS + 1).collect())
    if len(labels) > MOST_LABELS:
        raise ValueError(f"there are more than {MOST_LABELS} labels")
    weights = np.zeros((DIMS + 1, max(1, len(labels))))
    if len(labels) < 2:
        return Model(labels, weights.astype(np.float32), np.zeros(DIMS, bool))
    y = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int") - 1
    apart = F.pmod(F.xxhash64("text"), F.lit(APART)) == 0
    ready = materialize(featured(known, "text").select("features", y.alias("y"), apart.alias("apart")), "features")
    taught = ready.filter("not apart").select("features", "y")
    used = telling(_counts(taught, len(labels)))
    few, every = np.zeros((used.sum() + 1, len(labels))), np.ones(used.sum(), bool)
    seen = np.full(few.shape, 1e-8)
    packed = materialize(_packed(taught, used), "packed-features")  # the rounds read nothing else
    for _ in range(rounds):
        total, n = _gradient(packed, few.astype(np.float32), every)
        if not n:
            break
        slope = total / n + PENALTY * few
        seen += slope * slope
        few -= STEP * slope / np.sqrt(seen)
    weights[np.append(used, True)] = few
    weights = weights.astype(np.float32)
    losses = _losses(ready.filter("apart").select("features", "y"), weights, used)
    return Model(labels, weights, used, float(TEMPERATURES[losses.argmin()]) if losses.any() else 1.0)


def predict(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``rows`` with ``predicted`` and its ``probability``; the text is left out."""
    taken = {c.lower() for c in rows.columns} & {"predicted", "probability", "features", "__words"}
    if taken:
        raise ValueError(f"the input has {sorted(taken)} already")
    schema = T.StructType([*rows.drop(text_col).schema.fields, T.StructField("predicted", T.StringType()), T.StructField("probability", T.DoubleType())])
    labels, weights, used, temperature = pa.array(model.labels or [None], pa.string()), model.weights, model.used, model.temperature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = _softmax(_logits(batch, weights, used)[0] / temperature) if batch.num_rows else np.zeros((0, len(labels)))
            best = share.argmax(1)
            kept = batch.drop_columns(["features"])
            yield kept.append_column("predicted", labels.take(pa.array(best))).append_column("probability", pa.array(share[np.arange(len(best)), best]))

    small_batches(rows.sparkSession)
    return featured(rows, text_col).drop(text_col).mapInArrow(run, schema)


# Valence of a few common words; a fuller table is a parameter.
VALENCE = {"good": 1.9, "great": 3.1, "excellent": 2.7, "love": 3.2, "like": 1.5, "happy": 2.7, "nice": 1.8, "best": 3.2, "bad": -2.5, "terrible": -2.1, "awful": -2.0, "hate": -2.7, "sad": -2.1, "worst": -3.1, "angry": -2.3, "poor": -2.1}
# What an intensifier adds to the next word's valence, and words that turn it around.
INTENSITY = {"very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "slightly": -0.293, "somewhat": -0.293, "barely": -0.293}
NEGATIONS = frozenset({"not", "no", "never", "none", "without", "isn't", "wasn't", "don't", "doesn't", "didn't", "can't", "won't"})
TURN, SPREAD = -0.74, 15.0


def valence(text: str | None, words: dict[str, float] = VALENCE) -> float:
    """A text's sentiment from -1 to 1: valences with the intensifiers right before and negations up to three words before."""
    tokens = [t.strip(".,;:!?\"()") for t in (text or "").lower().split()]
    total = 0.0
    for i, t in enumerate(tokens):
        v = words.get(t, 0.0)
        if v:
            if i:
                v += INTENSITY.get(tokens[i - 1], 0.0) * (1 if v > 0 else -1)
            if NEGATIONS & set(tokens[max(0, i - 3) : i]):
                v *= TURN
            total += v
    return total / (total * total + SPREAD) ** 0.5


def sentiment(x: str, words: dict[str, float] = VALENCE) -> F.Column:
    """Sentiment of a text column; null counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: valence(t, words)).astype(float)

    return score(F.coalesce(F.col(x), F.lit("")))
