"""Byte-level BPE encoding and decoding over Arrow batches.

``encode`` cuts texts by the pattern and lets the ``tokenizers`` library merge each new piece, whose
bytes are mapped to printable characters; ``decode`` reverses that table. Ids are packed as
little-endian unsigned 32-bit integers, so that they pass between Spark and Python as one buffer;
``unpack`` turns them into an array column.

Results in special cases: null or empty text has no ids and decodes to no bytes; a character whose
bytes fall to several ids is whole again after decoding them all, and each of these ids has the span
of that character; an id outside the vocabulary is an error; repeated rows are encoded each; other
columns of the input are kept (one named like an output column is an error).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.llm import tokens


def _added(df: DataFrame, name: str, kind: T.DataType | None = None) -> T.StructType:
    if name.lower() in map(str.lower, df.columns):
        raise ValueError(f"the input has a column {name} already")
    return T.StructType([*df.schema.fields, T.StructField(name, kind or T.BinaryType(), True)])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with the packed ids of ``text_col`` as binary column ``out``; ``keep_text=False`` drops the text."""
    merges = tokens.merge_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.byte_encoder(path, pattern, merges)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array(coder.encode(part.column(text_col).to_pylist()), pa.binary())
                rest = part if keep_text else part.drop_columns([text_col])
                yield rest.append_column(out, ids)

    schema = _added(docs if keep_text else docs.drop(text_col), out)
    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of its packed ids as binary column ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.byte_decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [coder.decode(x) for x in part.column(ids_col).to_pylist()]
                yield part.append_column(out, pa.array(raw, pa.binary()))

    return coded.mapInArrow(run, _added(coded, out))


def spans(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``spans``: for each id the code points [start, stop) of the text that it touches."""
    schema = _added(coded, "spans", T.ArrayType(T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.byte_decoder(path)
        for batch in batches:
            found = [coder.spans(x or b"", coder.decode(x)).tolist() for x in batch.column(ids_col).to_pylist()]
            yield batch.append_column("spans", pa.array(found, pa.list_(pa.list_(pa.int64()))))

    return coded.mapInArrow(run, schema)


def unpack(ids_col: str = "ids") -> F.Column:
    """The packed ids as ``array<long>``."""
    return F.transform(
        F.when(F.length(ids_col) > 0, F.sequence(F.lit(0), (F.length(ids_col) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.concat(*[F.hex(F.substring(F.col(ids_col), i * 4 + F.lit(b), F.lit(1))) for b in (4, 3, 2, 1)]), 16, 10).cast("long"),
    )


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, from its ids and what they decode to."""
    coded = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path, pattern, keep_text=False)
    both = decode(coded, path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
