"""Token ids of texts by public vocabularies, one distinct piece of a batch at a time.

A text is cut by the vocabulary's own pattern; ``tokenizers`` encodes each piece that is new to the
worker, and a bounded table keeps the ids of short pieces. The ids equal those of a whole-text call,
because both vocabularies merge inside a piece only.
"""

from __future__ import annotations

import array
import base64
import functools
import os
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ragweave.llm.common import ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Pieces in each of the two generations that a worker keeps, and the longest that is kept.
MOST_PIECES, LONGEST_PIECE = 200_000, 48
#: Characters of a text that are cut into pieces at once.
BLOCK = 1 << 20
#: Characters of texts whose new pieces are encoded together.
GROUP = 1 << 12
#: A place where every pattern here ends a piece: a space between a visible character and a letter.
SEAM = regex.compile(r"(?<=\S)(?= \p{L})")


def blocks(text: str, most: int = BLOCK) -> Iterator[str]:
    """``text`` in blocks that end at a seam, so that a very long text isn't cut all at once."""
    at = 0
    while len(text) - at > most:
        found = SEAM.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Encoder:
    """Packed ids (little-endian unsigned 32-bit) of texts; subclasses give pattern and library."""

    library: object

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _missing(self, pieces: Iterable[str]) -> list[str]:
        """Pieces that aren't known. A full generation becomes the older one, whose used pieces come back."""
        if len(self.known) > MOST_PIECES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = {p for p in pieces if p not in known}
        if not new or not older:
            return list(new)
        used = {p: older[p] for p in new if p in older}  # never a walk over ``older``, which is large
        known |= used
        return [p for p in new if p not in used]

    def pieces(self, block: str) -> list[str]:
        """The parts of a block that are encoded apart; they may leave out what yields no ids."""
        raise NotImplementedError

    def whole(self, text: str) -> list[int] | None:
        """The ids of a text that must be seen as a whole, or None."""
        return None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; null counts as empty."""
        parts: list[list[bytes]] = [[] for _ in texts]
        cut: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if (ids := self.whole(text)) is not None:
                parts[i].append(self._pack(ids))
                continue
            for block in blocks(text):
                cut.append((i, self.pieces(block)))
                size += len(block)
                if size >= GROUP:
                    self._join(cut, parts)
                    cut, size = [], 0
        self._join(cut, parts)
        return [b"".join(p) for p in parts]

    def _join(self, cut: list[tuple[int, list[str]]], parts: list[list[bytes]]) -> None:
        """Append to ``parts`` the packed ids of blocks in pieces; all their new pieces are encoded at once."""
        packed = [list(map(self.known.get, pieces)) for _, pieces in cut]
        short = [at for at, x in enumerate(packed) if None in x]
        new = self._missing({p for at in short for p in cut[at][1]}) if short else []
        self.known |= self._encoded(new)
        for at in short:
            packed[at] = list(map(self.known.__getitem__, cut[at][1]))
        for (i, _), x in zip(cut, packed):
            parts[i].append(b"".join(x))
        for piece in new:
            if len(piece) > LONGEST_PIECE:
                del self.known[piece]

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids of each piece, from the library."""
        return {p: self._pack(x.ids) for p, x in zip(pieces, self.library.encode_batch_fast(pieces, add_special_tokens=False))} if pieces else {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        packed = array.array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``: what merging its bytes by lower ranks leaves."""
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(ranks.get(a + b, most), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank >= most:
            raise ValueError(f"token {token!r} can't be made by merges")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


@functools.lru_cache(maxsize=4)
def merge_ranks(path: str) -> bytes:
    """The ranks of both parts of each token that a merge makes, by rank, packed as 32-bit integers.

    It takes seconds, so the driver makes it once and the tasks get it with their function.
    """
    ranks = read_ranks(path)
    parts = (_last_merge(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1)
    return np.array([(ranks[a], ranks[b]) for a, b in parts], "<i4").tobytes()


#: Characters beyond the first plane: those that this Python doesn't know yet have no settled class.
FAR = regex.compile(r"[\U00010000-\U0010ffff]")


class ByteEncoder(Encoder):
    """Byte-level BPE by a file of ranks, each match of ``pattern`` separately.

    A text with a character that is unassigned here goes to ``tiktoken`` whole, as tables of newer
    Unicode versions differ about its class.
    """

    def __init__(self, path: str, pattern: str, merges: bytes | None = None):
        import tiktoken
        from tokenizers import Tokenizer, models, pre_tokenizers

        super().__init__()
        ranks, shown = read_ranks(path), byte_characters()
        names = {r: "".join(map(shown.__getitem__, t)) for t, r in ranks.items()}
        pairs = np.frombuffer(merge_ranks(path) if merges is None else merges, "<i4").reshape(-1, 2).tolist()
        self.pattern = regex.compile(pattern)
        self.library = Tokenizer(models.BPE({n: r for r, n in names.items()}, [(names[a], names[b]) for a, b in pairs], ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.other = functools.cache(lambda: tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))

    def pieces(self, block: str) -> list[str]:
        return self.pattern.findall(block)

    def whole(self, text: str) -> list[int] | None:
        if not text.isascii() and FAR.search(text) and any(unicodedata.category(c) == "Cn" for c in set(FAR.findall(text))):
            return self.other().encode_ordinary(text)
        return None


class ByteDecoder:
    """Bytes of packed ids by the reversed byte table."""

    def __init__(self, path: str):
        back = {c: b for b, c in enumerate(byte_characters())}
        shown = byte_characters()
        ranks = read_ranks(path)
        self.table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = bytes(back[c] for c in "".join(shown[b] for b in token))
        self.lengths = np.array([len(t or b"") for t in self.table], np.int64)
        self.known = np.array([t is not None for t in self.table], bool)

    def decode(self, packed: bytes | None) -> bytes:
        ids = np.frombuffer(packed or b"", "<u4")
        if len(ids) and (ids.max() >= len(self.table) or not self.known[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def spans(self, packed: bytes, raw: bytes) -> np.ndarray:
        """First and last + 1 code point of each id in its text; ids that split a character share it."""
        ends = np.cumsum(self.lengths[np.frombuffer(packed, "<u4")])
        lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        first = np.concatenate([[0], ends[:-1]])
        return np.stack([lead[first] - 1, lead[ends - 1]], 1).astype(np.int64) if len(ends) else np.zeros((0, 2), np.int64)


#: Characters whose normal form, case and class all tools agree on; other texts go to the library whole.
USUAL = regex.compile("[\t\n\r\x20-\x7e\xa0-\u012f\u0131-\u017f\u2010-\u2027\u20ac]*")


#: Marks at the end of a word that are tokens of their own after a letter.
TAIL = ".,;:!?"


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class WordEncoder(Encoder):
    """BPE with word ends over lower-cased words, by a ``tokenizers`` file; white space yields no ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.shown = byte_characters()

    def pieces(self, block: str) -> list[str]:
        return block.split()

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """A word of letters is one piece of the vocabulary's pattern, so it goes to the library's model at once."""
        out = super()._encoded([p for p in pieces if not p.isalpha()])
        for word in filter(str.isalpha, pieces):
            low = word.lower()
            raw = low if low.isascii() else "".join(map(self.shown.__getitem__, low.encode()))
            out[word] = self._pack([x.id for x in self.model.tokenize(raw)])
        return out

    def whole(self, text: str) -> list[int] | None:
        return None if USUAL.fullmatch(text) else self.library.encode(text, add_special_tokens=False).ids

    def _cores(self, cores: list[str]) -> list[bytes]:
        """Packed ids of lower-cased words."""
        new, known = self._missing(cores), self.known
        known |= self._encoded(new)
        packed = [known[c] for c in cores]
        for c in new:
            if len(c) > LONGEST_PIECE:
                del known[c]
        return packed

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct lower-cased words, concatenated, and how many each has; a mark at the end is apart."""
        trimmed = pc.utf8_rtrim(words, TAIL)
        apart = pc.and_(pc.equal(pc.subtract(pc.utf8_length(words), pc.utf8_length(trimmed)), 1), pc.match_substring_regex(trimmed, r"\p{L}$"))
        cores = pc.if_else(apart, trimmed, words).dictionary_encode()
        packed = self._cores(_strings(cores.dictionary))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        at = cores.indices.to_numpy()
        mark = apart.to_numpy(zero_copy_only=False)
        counts = sizes[at] + mark
        ids = np.empty(int(counts.sum()), "<u4")
        ends = np.cumsum(counts)
        starts = ends - counts
        ids[ragged(starts, sizes[at])] = np.frombuffer(b"".join(packed), "<u4")[ragged((np.cumsum(sizes) - sizes)[at], sizes[at])]
        last = pc.utf8_slice_codeunits(words.filter(apart), -1, 1 << 30).dictionary_encode()
        marks = np.frombuffer(b"".join(self._cores(_strings(last.dictionary))), "<u4")
        ids[ends[mark] - 1] = marks[last.indices.to_numpy()]
        return ids, counts

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, and where each text's begin and end; null counts as empty.

        Words are told apart by Arrow's dictionary, so Python sees each word of the column once.
        """
        column = pc.fill_null(column, "")
        if len(column) == 1 and column.nbytes > 8 * BLOCK:  # a very long text, block by block
            cut = list(blocks(column[0].as_py()))
            if len(cut) > 1:  # a text without seams stays whole and is encoded like any other
                parts = [self.encode_column(pa.array([b]))[0] for b in cut]
                return np.concatenate(parts), np.array([0, sum(map(len, parts))])
        odd = np.flatnonzero(~pc.match_substring_regex(column, "^(?:" + USUAL.pattern + ")$").to_numpy(zero_copy_only=False))
        usual = column
        if len(odd):
            mask = np.zeros(len(column), bool)
            mask[odd] = True
            usual = pc.if_else(pa.array(mask), "", column)
        split = pc.utf8_split_whitespace(pc.utf8_lower(usual))
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten()
        words = words.dictionary_encode()
        own, sizes = self._words(words.dictionary) if len(words.dictionary) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        at = words.indices.to_numpy()
        ids = own[ragged((np.cumsum(sizes) - sizes)[at], sizes[at])]
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[bounds]
        if not len(odd):
            return ids, ends
        parts = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for i in odd:
            parts[i] = np.array(self.whole(column[int(i)].as_py()) or [], "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


@functools.lru_cache(maxsize=4)
def byte_encoder(path: str, pattern: str, merges: bytes | None = None) -> ByteEncoder:
    """The encoder of this worker; ``merges`` are those of ``merge_ranks``, made here where they aren't given."""
    return ByteEncoder(path, pattern, merges)


@functools.lru_cache(maxsize=4)
def byte_decoder(path: str) -> ByteDecoder:
    return ByteDecoder(path)


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
