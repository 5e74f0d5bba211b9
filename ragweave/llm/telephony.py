"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM in RIFF files, to resampled PCM.

Companded bytes are expanded by 256-entry tables made from the published rules; ADPCM blocks of a
file are decoded side by side, one nibble of every block at a time; PCM is resampled by a polyphase
windowed-sinc filter, block by block, and stored as 16-bit RIFF.

Results in special cases: a null text counts as no bytes, a null file has null PCM; no samples give a
file with an empty data chunk; bytes that aren't a RIFF file of a known coding are an error; a trailing
partial ADPCM block is dropped; equal bytes give equal results; repeated rows are converted each;
further columns are ignored by ``store_texts`` and kept by ``convert``, where one that is named like the
output, in whatever case, is an error.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import row_blocks, text_views

#: Samples whose features are computed at once.
FEATURE_BLOCK = 1 << 20

# Format tags of RIFF files.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17

# How IMA ADPCM moves the step index for each nibble.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)

# The 89 step sizes of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


@functools.cache
def mu_law_table() -> np.ndarray:
    """PCM value of each mu-law byte: bits are inverted; sign, 3-bit segment, 4-bit step, bias 132."""
    b = ~np.arange(256) & 0xFF
    size = ((((b & 15) << 3) + 132) << ((b >> 4) & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


@functools.cache
def a_law_table() -> np.ndarray:
    """PCM value of each A-law byte: even bits are inverted; the first two segments are linear."""
    b = np.arange(256) ^ 0x55
    segment, step = (b >> 4) & 7, (b & 15) << 4
    size = np.where(segment == 0, step + 8, (step + 264) << np.maximum(segment - 1, 0))
    return np.where(b & 128, size, -size).astype(np.int16)


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks of ``block`` bytes; all blocks advance together."""
    n = len(data) // block
    raw = np.frombuffer(data, np.uint8)[: n * block].reshape(n, block)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2].astype(np.int32), 88)
    out = np.empty((n, 1 + 2 * (block - 4)), np.int16)
    out[:, 0] = value
    for i in range(2 * (block - 4)):
        nibble = (raw[:, 4 + i // 2] >> (4 * (i % 2))) & 15
        step = STEPS[index]
        move = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
        value = np.clip(value + np.where(nibble & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[nibble], 0, 88)
        out[:, 1 + i] = value
    return out.reshape(-1)


def encode_adpcm(samples: np.ndarray, block: int) -> bytes:
    """Mono IMA ADPCM blocks of ``samples`` (the last block repeats the last sample)."""
    per = 1 + 2 * (block - 4)
    n = -(-len(samples) // per)
    grid = np.pad(samples.astype(np.int32), (0, n * per - len(samples)), "edge").reshape(n, per) if n else np.zeros((0, per), np.int32)
    out = np.zeros((n, block), np.uint8)
    value = grid[:, 0].copy()
    index = np.minimum(np.searchsorted(STEPS, np.abs(np.diff(grid[:, :9], axis=1)).max(1)), 88).astype(np.int32) if n else np.zeros(0, np.int32)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(n, 2)
    out[:, 2] = index
    for i in range(per - 1):
        step, gap = STEPS[index], grid[:, 1 + i] - value
        nibble, left, move = np.where(gap < 0, 8, 0), np.abs(gap), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = left >= part
            nibble, left, move = nibble | np.where(take, bit, 0), left - np.where(take, part, 0), move + np.where(take, part, 0)
        value = np.clip(value + np.where(nibble & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[nibble], 0, 88)
        out[:, 4 + i // 2] |= (nibble << (4 * (i % 2))).astype(np.uint8)
    return out.tobytes()


def write_riff(data: bytes, coding: int, rate: int, block: int | None = None) -> bytes:
    """A mono RIFF file of already coded ``data``."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(coding, 8)
    align = block or bits // 8
    per_second = rate * bits // 8 if coding != IMA_ADPCM else rate * align // (1 + 2 * (align - 4))
    extra = struct.pack("<HH", 2, 1 + 2 * (align - 4)) if coding == IMA_ADPCM else b"" if coding == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", coding, 1, rate, per_second, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form
    if coding != PCM:
        count = len(data) if coding != IMA_ADPCM else len(data) // align * (1 + 2 * (align - 4))
        body += b"fact" + struct.pack("<II", 4, count)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_riff(media: bytes) -> tuple[int, int, int, bytes]:
    """(coding, rate, block size, data) of a mono RIFF file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave file")
    at, form = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data":
            if form is None or form[1] != 1 or form[0] not in (PCM, A_LAW, MU_LAW, IMA_ADPCM):
                raise ValueError("not a mono file of a known coding")
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def to_pcm(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a RIFF file."""
    coding, rate, block, data = read_riff(media)
    if coding == MU_LAW:
        return rate, mu_law_table()[np.frombuffer(data, np.uint8)]
    if coding == A_LAW:
        return rate, a_law_table()[np.frombuffer(data, np.uint8)]
    if coding == IMA_ADPCM:
        return rate, decode_adpcm(data, block)
    return rate, np.frombuffer(data[: len(data) // 2 * 2], "<i2")


def to_pcm_all(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(rate, 16-bit samples) of each file; ADPCM blocks of all files of a block size advance together."""
    out: list[tuple[int, np.ndarray]] = [(0, np.zeros(0, np.int16))] * len(files)
    coded: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, media in enumerate(files):
        coding, rate, block, data = read_riff(media)
        if coding == IMA_ADPCM:
            coded.setdefault(block, []).append((i, rate, data[: len(data) // block * block]))
        else:
            out[i] = to_pcm(media)
    for block, own in coded.items():
        samples = decode_adpcm(b"".join(data for _, _, data in own), block)
        ends = np.cumsum([len(data) // block * (1 + 2 * (block - 4)) for _, _, data in own])
        for (i, rate, _), part in zip(own, np.split(samples, ends[:-1])):
            out[i] = (rate, part)
    return out


@functools.cache
def _bank(up: int, down: int, half: int = 16) -> np.ndarray:
    """Filters of the ``up`` phases, each ``2 * half`` taps of a windowed sinc that sum to 1."""
    cut = min(1.0, up / down)
    at = (np.arange(up) / up)[:, None] - (np.arange(2 * half) - half + 1)[None, :]
    bank = np.sinc(at * cut) * np.cos(np.clip(at / (half + 1), -1, 1) * math.pi / 2) ** 2
    return bank / bank.sum(1, keepdims=True)


def resample(samples: np.ndarray, rate: int, target: int, block: int = 1 << 16) -> np.ndarray:
    """16-bit samples at ``target`` per second; memory follows ``block``, not the length."""
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    if up == down or not len(samples):
        return samples.astype(np.int16)
    bank = _bank(up, down)
    half = bank.shape[1] // 2
    n = len(samples) * up // down
    out = np.empty(n, np.int16)
    for a in range(0, n, block):
        k = np.arange(a, min(n, a + block)) * down
        first = int(k[0]) // up - half + 1
        near = samples[np.clip(np.arange(first, int(k[-1]) // up + half + 1), 0, len(samples) - 1)].astype(np.float64)
        windows = np.lib.stride_tricks.sliding_window_view(near, 2 * half)
        out[a : a + block] = np.clip(np.rint(np.einsum("ij,ij->i", windows[k // up - int(k[0]) // up], bank[k % up])), -32768, 32767)
    return out


#: Bytes of files that are decoded at once.
FILES_BLOCK = 1 << 20


def _file_blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Runs of files of about ``FILES_BLOCK`` bytes, one at least, and where each begins."""
    _, offsets = text_views(column)
    for a, b in row_blocks(offsets, FILES_BLOCK):
        yield a, column.slice(a, b - a).to_pylist()


def convert(rows: DataFrame, target: int, media_col: str = "media", out: str = "pcm") -> DataFrame:
    """``rows`` with ``out``: each file as resampled 16-bit PCM at ``target`` per second, itself a RIFF file."""
    if out.lower() in map(str.lower, rows.columns):
        raise ValueError(f"the input has a column {out} already")
    schema = rows.withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, files in _file_blocks(batch.column(media_col)):
                found = iter(to_pcm_all([x for x in files if x is not None]))
                pcm = [None if x is None else write_riff(resample(*next(found)[::-1], target).astype("<i2").tobytes(), PCM, target) for x in files]
                yield batch.slice(at, len(files)).append_column(out, pa.array(pcm, pa.binary()))

    return rows.mapInArrow(run, schema)


def payload(text: bytes, unit: int = 64) -> bytes:
    """``text`` and zeros up to a positive multiple of ``unit`` bytes."""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def levels(samples: np.ndarray) -> str:
    """Number, peak, mean square and zero crossings of samples; of no samples all are 0."""
    peak = power = crossings = 0
    for a in range(0, len(samples), FEATURE_BLOCK):
        x = samples[a : a + FEATURE_BLOCK + 1].astype(np.int64)  # one more, for the crossing into the next block
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[:FEATURE_BLOCK]
        peak, power = max(peak, int(np.abs(x).max())), power + int((x * x).sum())
    return f"n={len(samples)} peak={peak} ms={power // max(1, len(samples))} zc={crossings}"


#: Bytes of an ADPCM block of a stored text: those that payloads are padded to.
ADPCM_BLOCK = 64
#: Codings of a stored text's files, by column.
STORED = {"media": MU_LAW, "a_law": A_LAW, "adpcm": IMA_ADPCM}


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 8000) -> DataFrame:
    """(doc_id, n_bytes, media, a_law, adpcm): each text's bytes, padded, as the data of a RIFF file of each coding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _file_blocks(batch.column(1)):
                raw = [(t or "").encode() for t in texts]
                padded = list(map(payload, raw))
                files = [pa.array([write_riff(x, coding, rate, ADPCM_BLOCK if coding == IMA_ADPCM else None) for x in padded], pa.binary()) for coding in STORED.values()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raw)).cast(pa.int64()), pa.array(list(map(len, raw)), pa.int64()), *files], ["doc_id", "n_bytes", *STORED])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary, a_law binary, adpcm binary")


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, a_law string, adpcm string, pcm_bytes long, pcm_sha256 string"


def media_features(stored: DataFrame, target: int = 4000) -> DataFrame:
    """What the stored files hold, read back from their bytes.

    The payload's digests and the feature are those of ``media``; ``a_law`` and ``adpcm`` are the levels of
    these files' samples; ``pcm_bytes`` and ``pcm_sha256`` tell the resampled PCM that is stored of ``media``,
    whose samples' number and checksum end the feature.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, media in _file_blocks(batch.column("media")):
                part = batch.slice(at, len(media))
                doc, n, a_law, adpcm, pcm = (part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "a_law", "adpcm", "pcm"))
                heard = [[levels(x) for _, x in to_pcm_all(files)] for files in (media, a_law, adpcm)]
                data, kept = ([read_riff(x)[3] for x in files] for files in (media, pcm))
                text = [f"{x} m={len(k) // 2} crc={zlib.crc32(k):08x}" for x, k in zip(heard[0], kept)]
                columns = [doc, n, [*map(len, data)], [*map(sha, data)], [zlib.crc32(x[-64:]) for x in data], [*map(len, media)], [*map(sha, media)], text, heard[1], heard[2], [*map(len, pcm)], [*map(sha, pcm)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in MEDIA.split(", ")])

    return convert(stored, target).mapInArrow(run, MEDIA)
