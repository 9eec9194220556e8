"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece the table stores the last token of that prefix's encoding. That
token is unique: among the tokens that end there, it is the one whose pair with the last token
of the remaining prefix is left alone by the merges. Appending bytes extends the table and never
changes what is there; an edit recomputes from the edit until the table agrees with the old one
over the longest token's length.

A text is cut by the vocabulary's pattern first and each match is encoded for itself; a match
that is a token is that token. The vocabulary is a file of base64 tokens and ranks; its path is
a parameter, and every worker reads it once.

Defined cases: a null text is the empty text and has no tokens; lone surrogates cannot reach a
Spark string; texts of any length are encoded whole, a piece in time linear in its bytes;
repeated rows encode alike; an empty table gives an empty table; columns other than the id and
the text are not read, and a result column replaces an input column of its name.
"""

from __future__ import annotations

import base64
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import mapped

#: Pieces and pairs that a worker remembers; older ones are worked out again.
PIECES, PAIRS = 200_000, 400_000


class Vocabulary:
    """Ranks of byte strings, the tokens that end at each place, and which pairs stand."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[int]:
        """The tokens that the merges leave, lowest rank first, leftmost first. For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.tokens)), i) for i in range(len(parts) - 1))
            if rank == len(self.tokens):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, left: int, right: int) -> bool:
        """Whether the merges leave the pair as it is; left -1: whether the token alone stands."""
        key = (left + 1) << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.merged((self.tokens[left] if left >= 0 else b"") + self.tokens[right]) == ([left, right] if left >= 0 else [right])
            self.pairs[key] = known
        return known


    def last_tokens(self, data: str) -> list[int]:
        """The last token of every prefix of ``data`` (bytes as Latin-1), -1 for the empty one."""
        pairs, last, done = self.pairs, [-1], 0
        for end, (rank, size) in self.ends.iter(data):
            if end < done:
                continue
            left = last[end + 1 - size]
            known = pairs.get((left + 1) << 32 | rank)
            if known or known is None and self.stands(left, rank):
                last.append(rank)
                done = end + 1
        return last

    def read_back(self, last: list[int]) -> list[int]:
        """The tokens of the whole, from the last tokens of its prefixes."""
        out, at, tokens = [], len(last) - 1, self.tokens
        while at:
            out.append(token := last[at])
            at -= len(tokens[token])
        out.reverse()
        return out


class PrefixTable:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data = vocabulary, data.decode("latin-1")
        self.last = vocabulary.last_tokens(self.data)

    def append(self, data: bytes) -> None:
        self._extend(data.decode("latin-1"))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of bytes start to end; the number of entries worked out anew."""
        old, tail, shift = self.last, self.data[end:], start + len(data) - end
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self._extend(data.decode("latin-1"))
        return len(data) + self._extend(tail, old, shift)

    def _extend(self, more: str, old: list[int] | None = None, shift: int = 0) -> int:
        """Go on over ``more``; with the old table, only until the two agree over the longest token."""
        v, last, began = self.vocabulary, self.last, len(self.data)
        lead = max(0, began - v.longest + 1)
        self.data += more
        agreed = 0
        for end, (rank, size) in v.ends.iter(self.data[lead:]):
            end += lead + 1
            if end == len(last) and v.stands(last[end - size], rank):
                last.append(rank)
                agreed = agreed + 1 if old and old[end - shift] == rank else 0
                if agreed >= v.longest:
                    last += old[end - shift + 1 :]
                    return end - began
        return len(more)

    def ids(self) -> list[int]:
        return self.vocabulary.read_back(self.last)


class Encoder(dict):
    """Pieces to their packed ids. Remembers two generations of pieces, each of bounded size."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            v, data = self.vocabulary, piece.encode()
            rank = v.ranks.get(data)
            packed = array("i", v.read_back(v.last_tokens(data.decode("latin-1"))) if rank is None else [rank]).tobytes()
        if len(self) >= PIECES:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(vocabulary(path), pattern)


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the text column, array<int>."""
    at = docs.columns.index(text)

    def row(batch: pa.RecordBatch) -> list[pa.Array]:
        own = encoder(path, pattern)
        rows = [own.packed(x) if x else b"" for x in batch.column(at).to_pylist()]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
        return [pa.ListArray.from_arrays(pa.array(offsets), values)]

    return mapped(docs, row, [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])


def with_bytes(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of the token ids, binary. A null list is the empty list."""
    at = docs.columns.index(ids)

    def row(batch: pa.RecordBatch) -> list[pa.Array]:
        token, column = vocabulary(path).tokens.__getitem__, batch.column(at)
        return [pa.array([b"".join(map(token, column[i].values.to_numpy().tolist())) if column[i].is_valid else b"" for i in range(len(column))], pa.binary())]

    return mapped(docs, row, [T.StructField(decoded, T.BinaryType(), False)])
