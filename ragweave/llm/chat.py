r"""Chat formatting at the level of tokens.

Roles and texts are encoded apart from each other, before any shuffle; a conversation is then the
concatenation of these ids with reserved ids between them::

    START role SEP text END START role SEP text END ...

As a reserved id never comes out of the encoder, a text can't forge a turn in the ids. In the
rendered string the reserved ids are ``<|im_start|>``, ``<|im_sep|>`` and ``<|im_end|>``; wherever
a role or text has ``<``, some backslashes and ``|``, one more backslash goes in, which reading takes
out again, so the string can't be forged either. The loss mask is 1 where more assistant texts have
begun than ended, by prefix sums over the ids.

Conversations are assembled from rows sorted by conversation and turn, as a stream, so that a task
holds one finished conversation and not its rows. Results in special cases: null text or role counts
as empty; rows with equal turn are ordered by role and text ids; null turns come first; null conv_id is
a conversation of its own; repeated rows are repeated turns; an empty table gives no conversations;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm import tokens

MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
CONTROL, ESCAPED = regex.compile(r"<(\\*)\|"), regex.compile(r"<(\\*)\\\|")
#: Turns encoded at once.
STEP = 1024


def escape(text: str) -> str:
    return CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def reserved(path: str) -> tuple[int, int, int]:
    """The ids of the three marks: those after the vocabulary's last."""
    first = len(tokens.byte_decoder(path).table)
    return first, first + 1, first + 2


def encode_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, turn, role_ids, text_ids, loss) of rows (conv_id, turn, role, text)."""
    merges = tokens.merge_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.byte_encoder(path, pattern, merges)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                conv, turn, role, text = part.columns
                roles, texts = ([escape(x or "") for x in c.to_pylist()] for c in (role, text))
                loss = pa.array([r == "assistant" for r in role.to_pylist()])
                ids = [pa.array(coder.encode(x), pa.binary()) for x in (roles, texts)]
                yield pa.RecordBatch.from_arrays([conv, turn, *ids, loss], ["conv_id", "turn", "role_ids", "text_ids", "loss"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn long, role_ids binary, text_ids binary, loss boolean")


def splice(roles: list[bytes], texts: list[bytes], loss: list[bool], marks: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a conversation."""
    start, sep, end = (np.array([m], "<u4").tobytes() for m in marks)
    ids = np.frombuffer(b"".join(x for r, t in zip(roles, texts) for x in (start, r, sep, t, end)), "<u4")
    sizes = np.array([[1, len(r) // 4, 1, len(t) // 4, 1] for r, t in zip(roles, texts)], np.int64)
    ends = np.cumsum(sizes).reshape(-1, 5)
    edge = np.zeros(len(ids) + 1, np.int64)
    trained = np.array(loss, bool)
    np.add.at(edge, ends[trained, 2], 1)
    np.add.at(edge, ends[trained, 3], -1)
    return ids, np.cumsum(edge)[:-1].astype(np.uint8)


def assemble(encoded: DataFrame, path: str) -> DataFrame:
    """(conv_id, ids, loss_mask): packed ids and one byte per id, of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = reserved(path)
        now, held = None, None

        def finished() -> pa.RecordBatch:
            ids, mask = splice(*held, marks)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([mask.tobytes()], pa.binary())], ["conv_id", "ids", "loss_mask"])

        for batch in batches:
            for conv, role, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role_ids", "text_ids", "loss"))):
                if held is None or conv != now:
                    if held is not None:
                        yield finished()
                    now, held = conv, ([], [], [])
                for kept, x in zip(held, (role, text, loss)):
                    kept.append(x)
        if held is not None:
            yield finished()

    rows = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role_ids", "text_ids")
    return rows.mapInArrow(run, "conv_id long, ids binary, loss_mask binary")


def format_chats(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, ids, loss_mask) of rows (conv_id, turn, role, text)."""
    return assemble(encode_turns(turns, path, pattern), path)


def parse(packed: bytes, mask: bytes, path: str) -> tuple[list[tuple[str, str]], str, str]:
    """Turns, text under the loss mask, and the rendered string of a conversation's ids."""
    coder, marks = tokens.byte_decoder(path), reserved(path)
    ids, on = np.frombuffer(packed, "<u4"), np.frombuffer(mask, np.uint8).astype(bool)
    a, b, c = (np.flatnonzero(ids == m) for m in marks)
    own = ids < marks[0]
    whole = coder.decode(ids[own].tobytes())
    ends = np.zeros(len(ids) + 1, np.int64)  # of the bytes before each id; marks have none
    np.cumsum(np.where(own, coder.lengths[np.where(own, ids, 0)], 0), out=ends[1:])
    read = lambda first, stop: [whole[i:j].decode() for i, j in zip(ends[first].tolist(), ends[stop].tolist())]
    raw = list(zip(read(a + 1, b), read(b + 1, c)))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    trained = "".join(map(unescape, read(edges[::2], edges[1::2])))
    rendered = "".join(f"{MARKS[0]}{r}{MARKS[1]}{t}{MARKS[2]}" for r, t in raw)
    return [(unescape(r), unescape(t)) for r, t in raw], trained, rendered


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """What the ids and masks of ``format_chats`` say, one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            out = []
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss_mask"))):
                turns, trained, rendered = parse(ids, mask, path)
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(trained), sha(trained), len(rendered), len(mask), int(np.frombuffer(mask, np.uint8).sum())))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in READ.split(", ")])

    return formatted.mapInArrow(run, READ)
