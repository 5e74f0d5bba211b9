"""Language identification by bit-sliced Bloom filters of n-grams.

Training counts byte n-grams of lower-cased texts by language on a bounded sample of labelled rows
(about ``SAMPLE`` distinct texts a language at most, taken by a hash of the text). An n-gram belongs to each language where its rate is at
least half its highest rate; of these, the ``GRAMS`` most frequent of a language are kept. One table
holds all filters: slot i has bit L set if language L's filter has bit i set, so the AND of an
n-gram's ``HASHES`` slots is the set of all languages that contain it.

A text's score for L is its share of n-grams that L contains, corrected for the false positives that
the fill of L's filter implies, and divided by the mean of L's own training texts. The highest wins
(ties: the language first in the alphabet); ``score`` is its part of the sum over languages.

Results in special cases: text that is null or has no letter is ``und`` with score 0; letters without
any known n-gram give the first language with score 0; repeated rows are predicted each; no labelled
rows: every text is ``und``; very long texts are taken in blocks, whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.llm.common import free_name, materialize

SAMPLE, GRAMS, SIZES, SLOTS, HASHES = 4000, 20_000, (3, 5), 1 << 18, 3
LETTER = regex.compile(r"\p{L}")
#: ASCII that isn't a letter becomes a space; bytes of other characters stay.
CLASS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
BLOCK = 1 << 20


def _bytes(text: str) -> np.ndarray:
    return CLASS[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` bytes."""
    count = len(data) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(257) + data[j : j + count]
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def _parts(data: np.ndarray, n: int) -> Iterator[np.ndarray]:
    for a in range(0, max(1, len(data) - n + 1), BLOCK):
        yield grams(data[a : a + BLOCK + n - 1], n)


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  # (SLOTS, words of 64 languages)
    false_rate: np.ndarray
    usual: np.ndarray

    def shares(self, text: str) -> np.ndarray:
        """Corrected share of the text's n-grams that each language contains."""
        data = _bytes(text)
        hits, n = np.zeros(len(self.languages)), 0
        for size in SIZES:
            for g in _parts(data, size):
                n += len(g)
                for word in range(self.slots.shape[1]):
                    found = self.slots[slot(g, 0), word]
                    for i in range(1, HASHES):
                        found = found & self.slots[slot(g, i), word]
                    values, counts = np.unique(found, return_counts=True) if self.slots.dtype != np.uint8 else (np.arange(256), np.bincount(found, minlength=256))
                    for bit in range(min(64, len(self.languages) - 64 * word)):
                        hits[64 * word + bit] += counts[(values.astype(np.uint64) >> np.uint64(bit)) & np.uint64(1) == 1].sum()
        return np.clip((hits / max(n, 1) - self.false_rate) / (1 - self.false_rate), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        score = self.shares(text) / self.usual
        best = int(np.argmax(score))
        return self.languages[best], float(score[best] / score.sum()) if score[best] > 0 else 0.0


def slot(g: np.ndarray, i: int) -> np.ndarray:
    return ((g >> np.uint64(18 * i)) & np.uint64(SLOTS - 1)).astype(np.int64)


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for a in range(0, len(texts), 512):
                    data = [_bytes(t) for t in texts[a : a + 512]]
                    found, n = np.unique(np.concatenate([g for d in data for size in SIZES for g in _parts(d, size)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, sample: int = SAMPLE, most: int = GRAMS) -> Model:
    """Fit on rows (lang, text); null languages and texts without letters teach nothing."""
    rows = rows.select("lang", "text").filter("lang is not null and text rlike '\\\\p{L}'")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((SLOTS, 1), np.uint8), np.zeros(0), np.ones(0))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(sample / n))])
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    taken = hashed.filter(F.pmod("hash", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    taken = materialize(taken.dropDuplicates(["lang", "hash"]).select("lang", "text"), "language-sample")
    counts = materialize(count_grams(taken), "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.filter("n > 2").join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    own = rated.join(top, "gram").filter("rate >= 0.5 * top")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))).filter(F.col("rank") <= most)
    kept: dict[str, list[int]] = {lang: [] for lang in languages}
    for row in ranked.select("lang", "gram").collect():
        kept[row["lang"]].append(row["gram"])
    words = -(-len(languages) // 64)
    slots = np.zeros((SLOTS, words), np.uint64)
    for at, lang in enumerate(languages):
        g = np.array(kept[lang], np.int64).view(np.uint64)
        for i in range(HASHES):
            slots[slot(g, i), at // 64] |= np.uint64(1 << (at % 64))
    fill = np.array([float((slots[:, at // 64] >> np.uint64(at % 64) & np.uint64(1)).mean()) for at in range(len(languages))])
    model = Model(languages, slots.astype(np.uint8) if len(languages) <= 8 else slots, fill**HASHES, np.ones(len(languages)))
    own = _mean_shares(taken, model)
    model.usual = np.array([max(own.get(x, 1.0), 1e-3) for x in languages])
    return model


def _mean_shares(rows: DataFrame, model: Model) -> dict[str, float]:
    """Mean share of each language's own training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            shares = [float(model.shares(t)[model.languages.index(k)]) for k, t in zip(langs, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(shares, pa.float64())], ["lang", "share"])

    return {r["lang"]: r["m"] for r in rows.mapInArrow(run, "lang string, share double").groupBy("lang").agg(F.avg("share").alias("m")).collect()}


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with columns ``names``: language and score; the text is the only input."""
    rest = docs if keep_text else docs.drop(text_col)
    if taken := {n.lower() for n in names} & {c.lower() for c in rest.columns}:
        raise ValueError(f"the input has columns {sorted(taken)} already")
    schema = T.StructType([*rest.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(text_col).to_pylist()]
            part = batch if keep_text else batch.drop_columns([text_col])
            part = part.append_column(names[0], pa.array([x[0] for x in found], pa.string()))
            yield part.append_column(names[1], pa.array([x[1] for x in found], pa.float64()))

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """``docs`` whose text has a language with a score above ``least``; all columns stay."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = predict(docs, model, text_col, names=(lang, score))
    return found.filter((F.col(lang) != "und") & (F.col(score) > least)).drop(lang, score)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document, learned from the others with a language."""
    model = train(docs.filter(~held_out()).select("lang", "text"))
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep_text=False)
    return out.select("doc_id", "held_out", "lang_pred", "score")
