"""Removing segments of a document that say what a better one says, and chained compression."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.functions import text as X

_WORD = re.compile(r"\w+")


def _grams(segment: str, n: int = 3) -> frozenset[str]:
    """Distinct runs of ``n`` words; a segment of fewer words counts by its single words."""
    words = X.tokens(segment)
    return frozenset(X.runs(words, n)) or frozenset(words)


# Weights of length and content in a segment's rank.
LENGTH_WEIGHT, CONTENT_WEIGHT = 0.7, 0.3


def _rank(segment: str) -> float:
    tokens = _WORD.findall(segment.lower())
    content = sum(t not in X.STOP_WORDS for t in tokens) / len(tokens) if tokens else 0.0
    return LENGTH_WEIGHT * len(segment) + CONTENT_WEIGHT * content * len(segment)


def distinct_segments(text: str, threshold: float = 0.95, sentences: bool = False, rank: Callable[[str], float] = _rank) -> str:
    """``text`` without segments whose word trigrams overlap those of a kept, better segment above ``threshold``.

    Better is a higher rank, or earlier at equal rank; survivors keep their order. An index from trigrams
    to kept segments finds those that share any, so segments that share none are never compared.
    """
    parts = [p for p in (re.split(r"(?<=[.!?])\s+", text) if sentences else re.split(r"\n\s*\n", text)) if p.strip()]
    if len(parts) < 2:
        return (" " if sentences else "\n\n").join(parts)
    grams = [_grams(p) for p in parts]
    kept: list[int] = []
    by: dict[str, list[int]] = {}
    for i in sorted(range(len(parts)), key=lambda i: (-rank(parts[i]), i)):
        shared: dict[int, int] = {}
        for g in grams[i]:
            for j in by.get(g, ()):
                shared[j] = shared.get(j, 0) + 1
        if any(n / min(len(grams[i]), len(grams[j])) > threshold for j, n in shared.items()):
            continue
        kept.append(i)
        for g in grams[i]:
            by.setdefault(g, []).append(i)
    return (" " if sentences else "\n\n").join(parts[i] for i in sorted(kept))


def drop_repeats(df: DataFrame, threshold: float = 0.95, sentences: bool = False, text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` reduced by ``distinct_segments``; null stays null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame[text_col] = [t if t is None else distinct_segments(t, threshold, sentences) for t in frame[text_col]]
            yield frame

    return df.mapInPandas(run, df.schema)


Compressor = Callable[..., DataFrame]


def _strip(df: DataFrame, text_col: str, custom_patterns: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(text_col, X.strip_lines(text_col, custom=custom_patterns))


def _dedup(df: DataFrame, text_col: str, **parameters: object) -> DataFrame:
    return drop_repeats(df, text_col=text_col, **parameters)


COMPRESSORS: dict[str, Compressor] = {"header_footer_stripper": _strip, "ranking_aware_deduplication": _dedup}


def register_compressor(name: str, compressor: Compressor) -> None:
    """Add a technique (df, text_col, **parameters) by name."""
    COMPRESSORS[name] = compressor


def compress(df: DataFrame, techniques: list[dict[str, object]], text_col: str = "text") -> DataFrame:
    """Apply techniques in order; adds original_length, compressed_length, compression_ratio and techniques."""
    out = df.withColumn("original_length", F.length(text_col))
    for t in techniques:
        if t["name"] not in COMPRESSORS:
            raise ValueError(f"unknown technique {t['name']}")
        out = COMPRESSORS[t["name"]](out, text_col, **dict(t.get("parameters") or {}))
    ratio = F.when(F.col("original_length") > 0, F.length(text_col) / F.col("original_length")).otherwise(1.0)
    return out.withColumns({"compressed_length": F.length(text_col), "compression_ratio": ratio, "techniques": F.lit(",".join(str(t["name"]) for t in techniques))})
