"""Places for models: embedders, rerankers, generators; and stand-ins that need none.

A provider is a callable that adds a column. The stand-ins are deterministic and are no substitute for
a trained model's quality.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.functions.text import words

Generate = Callable[[list[str]], list[str]]


def word_vector(text: str | None, dims: int) -> np.ndarray:
    """Counts of words by hash and sign, scaled to length 1."""
    out = np.zeros(dims)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        out[h % dims] += 1 if h >> 16 & 1 else -1
    size = np.sqrt((out * out).sum())
    return (out / size if size else out).astype(np.float32)


def word_vectors(texts: Sequence[str | None], dims: int) -> np.ndarray:
    """``word_vector`` of each text; a word is hashed once."""
    words = [(t or "").lower().split() for t in texts]
    flat = pa.array([w for own in words for w in own], pa.string()).dictionary_encode()
    hashes = np.array([zlib.crc32(w.encode()) for w in flat.dictionary.to_pylist()], np.int64)[flat.indices.to_numpy()]
    row = np.repeat(np.arange(len(words)), [len(own) for own in words])
    out = np.bincount(row * dims + hashes % dims, np.where(hashes >> 16 & 1, 1.0, -1.0), len(words) * dims).reshape(-1, dims)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def embed(df: DataFrame, text_col: str = "text", dims: int = 64) -> DataFrame:
    """``df`` with stand-in embeddings; blank texts are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 512):
                part = f.iloc[a : a + 512]
                yield part.assign(embedding=list(word_vectors(part[text_col], dims)))

    rows = df.filter(F.trim(text_col) != "")
    return rows.mapInPandas(run, rows.withColumn("embedding", F.lit(None).cast("array<float>")).schema)


#: Embedders by name: (df, text_col, dims) to df with the column embedding.
CONNECTORS: dict[str, Callable[..., DataFrame]] = {"words": embed}


def register_connector(name: str, embedder: Callable[..., DataFrame]) -> None:
    """Add an embedder, such as a model server behind ``batched``, by name."""
    CONNECTORS[name] = embedder


def embedded(df: DataFrame, connector: str, text_col: str = "text", dims: int = 64) -> DataFrame:
    """``df`` with embeddings by the connector of that name; an unknown one is an error."""
    if connector not in CONNECTORS:
        raise ValueError(f"unknown connector {connector}")
    return CONNECTORS[connector](df, text_col, dims)


def batched(call: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 32) -> Callable[..., DataFrame]:
    """An embedder of a callable that takes texts and gives a vector each, ``batch`` texts at once; blank texts are dropped."""

    def run_all(df: DataFrame, text_col: str = "text", dims: int = 64) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                found: list[Sequence[float]] = []
                for a in range(0, len(f), batch):
                    found += list(call(list(f[text_col].iloc[a : a + batch])))
                if any(len(v) != dims for v in found):
                    raise ValueError(f"vectors of {dims} numbers were asked for")
                yield f.assign(embedding=[np.asarray(v, np.float32) for v in found])

        rows = df.filter(F.trim(text_col) != "")
        return rows.mapInPandas(run, rows.withColumn("embedding", F.lit(None).cast("array<float>")).schema)

    return run_all


def generated(df: DataFrame, prompt_col: str, generate: Generate, out: str = "generated", batch: int = 16) -> DataFrame:
    """``df`` with the generator's text for each prompt, in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts: list[str] = []
            for a in range(0, len(f), batch):
                texts += generate(list(f[prompt_col].iloc[a : a + batch]))
            yield f.assign(**{out: texts})

    return df.mapInPandas(run, df.withColumn(out, F.lit(None).cast("string")).schema)


def first_words(n: int = 40) -> Generate:
    """A stand-in summariser: the first words."""
    return lambda prompts: [" ".join((p or "").split()[:n]) for p in prompts]


def _joined(rows: DataFrame, key: str, order: str, text: str, separator: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), separator).alias(text))


def summarize(chunks: DataFrame, generate: Generate, kind: str = "map_reduce", key: str = "doc_id", order: str = "chunk", text: str = "text") -> DataFrame:
    """(key, summary) of chunks by one call (stuff), a call each and one over them (map_reduce), or a fold (refine)."""
    if kind == "stuff":
        return generated(_joined(chunks, key, order, text, "\n"), text, generate, "summary").select(key, "summary")
    if kind == "map_reduce":
        each = generated(chunks, text, generate, "part").select(key, order, F.col("part").alias(text))
        return generated(_joined(each, key, order, text, "\n"), text, generate, "summary").select(key, "summary")
    if kind == "refine":
        kind_of = chunks.schema[key].dataType.simpleString()

        def fold(f: pd.DataFrame) -> pd.DataFrame:
            so_far = ""
            for t in f.sort_values(order)[text]:
                so_far = generate([f"{so_far}\n{t}".strip()])[0]
            return pd.DataFrame({key: [f[key].iloc[0]], "summary": [so_far]})

        return chunks.groupBy(key).applyInPandas(fold, f"`{key}` {kind_of}, summary string")
    raise ValueError(f"unknown kind {kind}")


def language_votes(df: DataFrame, vocabulary: dict[str, list[str]], text_col: str = "text", out: str = "language") -> DataFrame:
    """The language with most of its common words in a text; ties go to the first in the alphabet."""
    tokens = words(text_col)
    found = lambda v: F.size(F.filter(tokens, lambda w: w.isin(v)))
    scores = [F.struct((-found(v)).alias("n"), F.lit(k).alias("l")) for k, v in sorted(vocabulary.items())]
    return df.withColumn(out, F.array_min(F.array(*scores))["l"])
