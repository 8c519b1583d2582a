"""Byte-level byte-pair encoding and decoding over padded numpy matrices.

Pieces of like length stand together as rows of a matrix of token ids. In a round
every row merges its leftmost pair of minimum rank; the rank of a pair comes from a
hash table over numpy arrays. Finished rows leave the matrix, the others close up.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stallwise.llm.common import plain

#: Rank of a pair that makes no token.
NONE = np.int32(2**31 - 1)
#: Cells of one matrix. Longer pieces than ``LONG`` bytes are merged one by one.
CELLS, LONG = 1 << 20, 256
#: Characters of texts whose pieces are held at once, and pieces of one long text.
GROUP, SLICE = 1_000_000, 100_000
KEPT_LENGTH = 64

# Code points that newer character tables call letters or numbers and that the tables of the library
# to be matched (version 16) don't hold, so that its patterns take them as neither.
LATER = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
    10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
    16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
    1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
    1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
_LATER = re.compile("[" + "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in LATER.split()) + "]")
#: Stands in for them when a text is split: a sign that is no letter, number or space in any version.
_SIGN = "☃"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is the token's id, of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Rank of what two adjacent tokens make, by open addressing with linear steps."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(2 * len(rank)).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.key, self.rank = np.full(1 << bits, self.EMPTY), np.full(1 << bits, NONE, np.int32)
        key = self._key(left, right)
        slot, todo = self._slot(key), np.arange(len(key))
        while todo.size:
            at = slot[todo]
            free = self.key[at] == self.EMPTY
            self.key[at[free]] = key[todo[free]]  # of several keys for one place the last has it, the others go on
            won = self.key[at] == key[todo]
            self.rank[at[won]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = slot[todo] + 1 & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape, key = left.shape, self._key(left.ravel(), right.ravel())
        slot = self._slot(key)
        there = self.key[slot]
        out = np.where(there == key, self.rank[slot], NONE)
        todo = np.flatnonzero((there != key) & (there != self.EMPTY))
        while todo.size:
            slot[todo] = slot[todo] + 1 & self.mask
            there = self.key[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (there != self.EMPTY)]
        return out.reshape(shape)


class ByteBpe:
    """Encoder and decoder for one rank table. ``limit`` bounds the pieces that are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 150_000):
        import regex

        self.ranks, self.limit = ranks, limit
        self.split = regex.compile(pattern)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pad = np.int32(max(ranks.values()) + 1)
        made = [(ranks.get(t[:i]), ranks.get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t))]
        self.pairs = PairTable(*np.array([m for m in made if None not in m], np.int32).reshape(-1, 3).T)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> Iterator[str]:
        """Matches of the pattern, as the library's own character tables have them."""
        as_seen = text if text.isascii() else _LATER.sub(_SIGN, text)
        if as_seen is text or as_seen == text:
            return (m.group() for m in self.split.finditer(text))
        return (text[m.start():m.end()] for m in self.split.finditer(as_seen))

    def _list(self, text: str) -> list[str]:
        if text.isascii() or not _LATER.search(text):
            return self.split.findall(text)
        return list(self.pieces(text))

    def merge_rows(self, ids: np.ndarray) -> list[bytes]:
        """Packed ids of each row of a matrix padded on the right: one merge per row and round."""
        out: list = [None] * len(ids)
        live = np.arange(len(ids))
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while live.size:
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                best = rank[np.arange(live.size), at]
                goes_on = best != NONE
            else:
                goes_on = np.zeros(live.size, bool)
            if not goes_on.all():
                done = ids[~goes_on]
                flat, wide = done.astype("<u4").tobytes(), 4 * done.shape[1]
                sizes = 4 * (done != self.pad).sum(axis=1)
                for i, (row, size) in enumerate(zip(live[~goes_on].tolist(), sizes.tolist())):
                    out[row] = flat[i * wide:i * wide + size]
                if not goes_on.any():
                    break
                live, ids, rank, at, best = (x[goes_on] for x in (live, ids, rank, at, best))
            rows, place = np.arange(live.size), np.arange(ids.shape[1] - 1)
            ids = np.where(place <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[rows, at] = best
            rank = np.where(place[:-1] < at[:, None], rank[:, :-1], rank[:, 1:])
            if rank.shape[1]:
                for j in (np.maximum(at - 1, 0), np.minimum(at, rank.shape[1] - 1)):  # pairs with the new token
                    rank[rows, j] = self.pairs.get(ids[rows, j], ids[rows, j + 1])
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Ids of one long piece. A round merges all pairs of the minimum rank from the left, which is the same as a
        round for each, up to the first that makes a pair of lower rank: from there the next round looks again."""
        rank = self.pairs.get(ids[:-1], ids[1:])
        while rank.size and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            n = np.arange(at.size)
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, n, 0))
            at = at[(n - run) % 2 == 0]  # of pairs that overlap every other one
            token = np.full(at.size, best, np.int32)
            behind = np.full(at.size, NONE, np.int32)
            has = at + 2 < ids.size
            behind[has] = self.pairs.get(token[has], ids[at[has] + 2])
            before = np.where(np.diff(at, prepend=-2) == 2, best, ids[np.maximum(at - 1, 0)])
            ahead = np.where(at > 0, self.pairs.get(before, token), NONE)
            lower = np.flatnonzero(np.minimum(ahead, behind) < best)
            if lower.size:
                at = at[:lower[0] + 1]
            stays = np.ones(ids.size, bool)
            stays[at + 1] = False
            ids[at] = best
            ids = ids[stays]
            rank = rank[np.flatnonzero(stays)[:-1]]
            new = at - np.arange(at.size)
            for j in (new[new > 0] - 1, new[new < rank.size]):
                rank[j] = self.pairs.get(ids[j], ids[j + 1])
        return ids

    def _learn(self, pieces: Iterable[str]) -> None:
        """Work out the ids of pieces not seen so far, by buckets of like length."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            if (seen := self.older.get(piece)) is not None:
                self.known[piece] = seen
                continue
            raw = piece.encode("utf-8", "replace")
            if (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                ids = self.merge_long(self.first[np.frombuffer(raw, np.uint8)])
                self.known[piece] = ids.astype("<u4").tobytes()
            else:
                buckets.setdefault(4 << max(0, (len(raw) - 1).bit_length() - 2), []).append((piece, raw))
        for width, rows in buckets.items():
            for start in range(0, len(rows), max(1, CELLS // width)):
                part = rows[start:start + max(1, CELLS // width)]
                flat = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in part), np.uint8)
                ids = self.first[flat].reshape(len(part), width)
                lengths = np.array([len(raw) for _, raw in part])
                ids[np.arange(width) >= lengths[:, None]] = self.pad
                for (piece, _), found in zip(part, self.merge_rows(ids)):
                    self.known[piece] = found

    def _pack(self, lists: list[list[str]]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        new = set().union(*lists).difference(self.known)
        self._learn(new)
        packed = [b"".join(map(self.known.__getitem__, pieces)) for pieces in lists]
        for piece in new:
            if len(piece) > KEPT_LENGTH:
                del self.known[piece]
        return packed

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        group, size = [], 0
        for text in texts:
            if len(text) > GROUP or size + len(text) > GROUP:
                yield from self._pack(group)
                group, size = [], 0
            if len(text) > GROUP:
                rest, parts = self.pieces(text), []
                while some := list(islice(rest, SLICE)):
                    parts += self._pack([some])
                yield b"".join(parts)
            else:
                group.append(self._list(text))
                size += len(text)
        yield from self._pack(group)


#: One encoder for each vocabulary and pattern, kept by a Python worker from task to task.
_REMEMBERED: dict[tuple[str, str], ByteBpe] = {}


def unpack(ids: bytes, token: dict[int, bytes]) -> bytes | None:
    """The bytes of packed ids; None when they aren't whole ids of the table."""
    if len(ids) % 4:
        return None
    try:
        return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    except KeyError:
        return None


def _remembered(path: str, pattern: str, ranks: dict[bytes, int]) -> ByteBpe:
    if (path, pattern) not in _REMEMBERED:
        _REMEMBERED[path, pattern] = ByteBpe(ranks, pattern)
    return _REMEMBERED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id, n_tokens, ids`` by the rank file at ``path``, each match of ``pattern`` by itself.

    ``ids`` is binary: little-endian unsigned 32-bit integers, the form that token files have. A null or empty text has
    none; strings of special tokens are ordinary text. Repeated rows are encoded each by itself, an empty table gives
    no rows, further columns are not read. The vocabulary goes out by broadcast: its size is the file's. A task holds
    the pieces of about a million characters; a longer text goes through in slices. No shuffle.
    """
    rows = plain(docs, id, text)
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    key = rows.schema["id"]
    schema = T.StructType([T.StructField(id, key.dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _remembered(path, pattern, sent.value)
        for batch in batches:
            ids = list(bpe.encode_all(value.as_py() for value in batch.column("body")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=[id, "n_tokens", "ids"])

    return rows.mapInArrow(run, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids") -> Column:
    """The bytes that packed ids stand for, as a column of ``frame``; null for null and for ids not in the file."""
    sent = frame.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(path).items()})

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = sent.value
        for batch in batches:
            yield pd.Series([None if x is None else unpack(bytes(x), token) for x in batch], dtype=object)

    return run(F.col(ids))
