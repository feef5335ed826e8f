"""Byte-level BPE encoding and decoding by length-bucketed padded numpy matrices.

The distinct pre-tokens of a batch are laid out as rows of padded id matrices,
one matrix per power-of-two length.  In each round every row merges its
leftmost pair of least rank; pair ranks come from an open-addressing hash table
of all mergeable pairs; rows that have no mergeable pair leave the matrix and
the others are compacted.  Pre-tokens are found once per distinct
space-delimited chunk: in every published byte-level split pattern a single
space between two non-space characters starts a new pre-token, so chunks can be
split on their own.

Defined results: null text encodes as the empty text (no ids); a null id list
decodes to empty bytes; ids outside the vocabulary raise; an input column named
like the output column is replaced; repeated rows each give their own row.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunked import MAX_CHUNKS, ChunkedEncoder
from .common import binary_view, set_column, slices, with_field, worker_cache

NONE = np.int32(2**31 - 1)  # "no such pair"
LONG_PIECE = 256  # rows of more bytes are merged one by one


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a ``.tiktoken`` rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class PairTable:
    """Mergeable pairs -> rank, in an open-addressing table probed by whole vectors."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, vals = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(rank)
        key, val = np.array(keys, np.uint64), np.array(vals, np.int32)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.vals = np.full(1 << bits, NONE)
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 1
        while len(todo):  # place whole vectors: the first claimant of a free slot gets it
            free = self.keys[slot] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.vals[slot[put]] = key[todo[put]], val[todo[put]]
            todo, slot = todo[~put], slot[~put]
            taken = self.keys[slot] != key[todo]
            todo, slot = todo[taken], (slot[taken] + 1) & self.mask
            self.probes += len(todo) > 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NONE`` where it does not merge or a side is padding (-1)."""
        key = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.vals[slot], NONE)
        miss = np.flatnonzero((found != key) & (found != np.uint64(2**64 - 1)))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            found = self.keys[slot[miss]]
            hit = found == key[miss]
            out[miss[hit]] = self.vals[slot[miss[hit]]]
            miss = miss[~hit & (found != np.uint64(2**64 - 1))]
        return out


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks some single bytes")
        self.chunked = ChunkedEncoder(self._learn)
        self.pieces: dict[str, bytes] = {}

    def _rank_matrix(self, ids: np.ndarray) -> np.ndarray:
        left, right = ids[:, :-1], ids[:, 1:]
        out = np.full(left.shape, NONE)
        real = right >= 0
        out[real] = self.pairs.rank(left[real], right[real])
        return out

    def _merge_rows(self, ids: np.ndarray) -> list[bytes]:
        """Final ids (as bytes) of each row of a padded (-1) matrix."""
        done = np.full(ids.shape, -1, np.int32)
        at, rank = np.arange(len(ids)), self._rank_matrix(ids)
        while len(at):
            best = rank.argmin(axis=1)
            least = rank[np.arange(len(at)), best]
            over = least == NONE
            if over.any():
                done[at[over], :ids.shape[1]] = ids[over]
                at, ids, rank, best, least = at[~over], ids[~over], rank[~over], best[~over], least[~over]
                if not len(at):
                    break
            rows = np.arange(len(at))
            ids[rows, best] = least  # the merged token's id is its rank
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), axis=1)  # close the gap
            # the row lost one entry at best + 1; the last column is padding unless the row was full
            if ids.shape[1] == 1:
                rank = np.full((len(at), 1), NONE)
                continue
            cols = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, cols + (cols >= best[:, None]), axis=1)
            for shift in (-1, 0):  # the two pairs beside the merged token
                col = best + shift
                ok = (col >= 0) & (col < rank.shape[1])
                r, c = rows[ok], col[ok]
                a, b = ids[r, c], ids[r, c + 1]
                new = np.full(len(r), NONE)
                real = b >= 0
                new[real] = self.pairs.rank(a[real], b[real])
                rank[r, c] = new
        real = done >= 0
        ends = (real.sum(axis=1).cumsum() * 4).tolist()
        flat = done[real].tobytes()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row.  A round merges every non-overlapping least pair, left to right, if no pair
        that arises on the way ranks below it (the result is then that of one merge at a time);
        else only the leftmost."""
        rank = self.pairs.rank(ids[:-1], ids[1:])
        while len(rank):
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            starts = np.flatnonzero(np.diff(at, prepend=-5) > 1)
            within = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            at = at[within % 2 == 0]
            new, kept = ids.copy(), np.ones(len(ids), bool)
            new[at] = least
            kept[at + 1] = False
            before = np.where(kept[np.maximum(at - 1, 0)], at - 1, at - 2)
            has_left, has_right = at > 0, at + 2 < len(ids)
            low = (self.pairs.rank(new[before[has_left]], new[at[has_left]]) < least).any()
            low = low or (self.pairs.rank(new[at[has_right]], ids[at[has_right] + 2]) < least).any()
            if low:
                at = at[:1]
                new, kept = ids.copy(), np.ones(len(ids), bool)
                new[at] = least
                kept[at + 1] = False
            ids = new[kept]
            rank = self.pairs.rank(ids[:-1], ids[1:])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of each pre-token."""
        out = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[i] = self._merge_long(self.byte_id[np.frombuffer(piece, np.uint8)]).tobytes()
            elif piece:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, rows in buckets.items():
            width = 1 << bits
            for k in range(0, len(rows), 1 << 14):
                part = rows[k:k + (1 << 14)]
                flat = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in part]), np.uint8)
                ids = self.byte_id[flat.reshape(len(part), width)]
                lens = np.array([len(pieces[i]) for i in part])
                ids[np.arange(width) >= lens[:, None]] = -1
                for i, line in zip(part, self._merge_rows(ids)):
                    out[i] = line
        return out

    def _learn(self, chunks: list[str]) -> list[bytes]:
        known = self.pieces
        if len(known) > MAX_CHUNKS:
            known.clear()
        split = list(map(self.split, chunks))
        fresh = list(set().union(*split).difference(known))
        known.update(zip(fresh, self.encode_pieces([p.encode() for p in fresh])))
        return [known[ps[0]] if len(ps) == 1 else b"".join(map(known.__getitem__, ps)) for ps in split]

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, in order."""
        return self.chunked.encode(texts)


def _codec(ranks: dict[bytes, int], pattern: str, key: tuple) -> Codec:
    cache = worker_cache("bpe")
    if key not in cache:
        cache.clear()
        cache[key] = Codec(ranks, pattern)
    return cache[key]


def _tokens(ranks: dict[bytes, int], key: tuple) -> list[bytes]:
    cache = worker_cache("bpe_tokens")
    if key not in cache:
        cache.clear()
        cache[key] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            cache[key][rank] = token
    return cache[key]


def _shipped(df: DataFrame, path: str, pattern: str):
    ranks = read_ranks(path)  # a vocabulary file: fixed size
    return df.sparkSession.sparkContext.broadcast(ranks), (path, pattern, len(ranks))


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with ``out_col`` (array<int>): the BPE ids of ``text_col``, special strings as ordinary text."""
    ranks, key = _shipped(df, ranks_path, pattern)

    def run(batches):
        codec = _codec(ranks.value, pattern, key)
        for batch in slices(batches, text_col):
            flat, offsets = codec.chunked.encode_rows(*binary_view(batch.column(batch.schema.names.index(text_col))))
            yield set_column(batch, out_col, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)))

    return df.mapInArrow(run, with_field(df.schema, out_col, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col`` (binary): the bytes that ``ids_col`` stands for."""
    ranks, key = _shipped(df, ranks_path, pattern)

    def run(batches):
        tokens = _tokens(ranks.value, key)
        for batch in slices(batches, ids_col):
            out = [b"".join([tokens[i] for i in row]) if row else b"" for row in _id_rows(batch.column(ids_col))]
            yield set_column(batch, out_col, pa.array(out, pa.binary()))

    return df.mapInArrow(run, with_field(df.schema, out_col, T.BinaryType()))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
               out_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass, with one Python worker a task."""
    ranks, key = _shipped(df, ranks_path, pattern)

    def run(batches):
        codec, tokens = _codec(ranks.value, pattern, key), _tokens(ranks.value, key)
        for batch in slices(batches, text_col, 2 << 20):
            flat, offsets = codec.chunked.encode_rows(*binary_view(batch.column(batch.schema.names.index(text_col))))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            back = pa.array([b"".join([tokens[i] for i in row]) for row in _id_rows(ids)], pa.binary())
            yield set_column(set_column(batch, ids_col, ids), out_col, back)

    schema = with_field(with_field(df.schema, ids_col, T.ArrayType(T.IntegerType())), out_col, T.BinaryType())
    return df.mapInArrow(run, schema)


def _id_rows(col: pa.Array):
    """Each row of a list<int> array as a Python list (None for null), row by row."""
    for row in col:
        yield row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else None
