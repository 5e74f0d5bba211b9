"""Large dumps and merged audio."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def encyclopedia_texts(spark: SparkSession, path: str, tag: str = "page") -> DataFrame:
    """(title, text) of an XML dump's pages, without brackets; blank pages go."""
    schema = "title string, revision struct<text: string>"
    pages = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return pages.select("title", F.trim(F.translate("revision.text", "[]{}", "")).alias("text")).filter("text <> ''")


def _wave(data: bytes) -> tuple[bytes, bytes]:
    """Format chunk and samples of a RIFF file."""
    at, form = 12, b""
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            form = body
        elif kind == b"data":
            return form, body
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def merge_waves(files: list[bytes]) -> bytes:
    """One file with the samples of all, in order; formats must agree."""
    parts = [_wave(f) for f in files]
    if len({form for form, _ in parts}) > 1:
        raise ValueError("formats differ")
    form, data = parts[0][0], b"".join(body for _, body in parts)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def merged_audio(parts: DataFrame, key: str = "request_id", order: str = "part", audio: str = "audio") -> DataFrame:
    """(key, audio): the parts of each request as one file."""
    kind = parts.schema[key].dataType.simpleString()

    def join(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [f[key].iloc[0]], audio: [merge_waves([bytes(x) for x in f.sort_values(order)[audio]])]})

    return parts.groupBy(key).applyInPandas(join, f"`{key}` {kind}, {audio} binary")
