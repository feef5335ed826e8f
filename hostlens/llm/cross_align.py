"""Alignment of two tokenizers' tokens, with corpus-wide counts of aligned id pairs.

Tokenizer A is a byte-level BPE file (tokenizers library), B a sentencepiece
model; both see a space and the text, so that their tokens cut the same bytes.
Where both end a token, a *group* ends; an A token and a B token whose bytes
overlap are *linked*.  The ends of either kind cut a text into pieces of exactly
one A and one B token each, and every link is one such piece, so links are read
off the merged ends.  An id pair's count is the number of documents that hold it.

1. Texts are tokenised once and their ids are written; each task also gives the
   distinct linked pairs that it saw.
2. Distinct pairs fall into buckets of bounded size; each bucket builds a minimal
   perfect hash (levels of bit arrays in which keys that meet nobody stay) and
   keeps its keys in hash order, to verify look-ups.
3. Tasks align the written documents and add up dense count vectors indexed by
   the hash; these are summed as a tree, block by block.
4. A second pass aligns the documents again, looks their links up and verifies
   the keys.

What is broadcast has at most ``most_keys`` pairs (24 bytes each); more pairs are
dealt to several such shards, each with passes of its own, whose sums are added.
The largest count of each A id is a vector as long as A's vocabulary.

Defined results: null and empty texts, and texts whose joined token bytes differ
from space and text, have no tokens, groups or links (zeros, ``groups`` is '').
Every row is a document of its own: repeated rows and rows that share an id each
count and each give a row; a null id is kept; only the id and text columns are
read, so clashing columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import ChunkedEncoder
from .common import binary_view, mix64, saved, slices, worker_cache
from .token_orc import byte_letters, chunk_encoder

MOST_KEYS = 1 << 21  # pairs of a shard
BUCKET_KEYS = 1 << 15  # pairs of a bucket, about
BLOCK = 1 << 16  # entries of a count vector that travel together
FAN = 32  # vectors summed by one task
SEEN_KEYS = 1 << 20  # distinct pairs a task keeps before it gives them
SPACE_MARK = "▁"

TOKENS = "row bigint, doc_id bigint, a binary, b binary, pairs binary"
RESULT = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
          "count_sum bigint, groups string")


# ---- tokens -----------------------------------------------------------------------------------------------------------

def a_token_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    spec = json.loads(vocabulary)
    entries = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", [])}}
    byte_of = {c: b for b, c in byte_letters().items()}
    out = [b""] * (max(entries.values()) + 1)
    for text, i in entries.items():
        out[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
    return out


def b_token_bytes(pieces) -> list[bytes]:
    """The bytes of each id of a sentencepiece model."""
    return [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i)
            else pieces.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(pieces.get_piece_size())]


def _encoder(vocabulary: str, a_key: str, model: bytes, b_key: str):
    """An encoder whose ids of a chunk are A's and then B's, these as ``-2 - id``; a chunk that does not come back
    is the id -1.  With it, whether chunks are whole rows, and the byte lengths of A's and B's ids."""
    cache = worker_cache("cross_align")
    if (a_key, b_key) not in cache:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        a_bytes, b_bytes = a_token_bytes(vocabulary), b_token_bytes(pieces)
        # a chunk's pieces are its own only if no piece has a space after another character
        inner = any(SPACE_MARK in pieces.id_to_piece(i).lstrip(SPACE_MARK) for i in range(pieces.get_piece_size()))
        plain = chunk_encoder(vocabulary, a_key, special_as_text=True, most=0, most_words=200_000)
        bad = np.array([-1], np.int32).tobytes()

        def learn(chunks: list[str]) -> list[bytes]:
            whole = [c.encode() for c in chunks]
            a = plain.learn(chunks)
            # chunks begin with the space that the model adds itself
            ids = pieces.encode([c[1:] for c in chunks], num_threads=1) if chunks else []
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            ends = 4 * np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            raw = np.subtract(-2, flat, dtype=np.int32).tobytes()
            out = [x + raw[i:j] for x, i, j in zip(a, [0, *ends.tolist()], ends.tolist())]
            back_a = [b"".join([a_bytes[i] for i in memoryview(x).cast("i")]) for x in a]
            back_b = [b"".join([b_bytes[i] for i in y]) for y in ids]
            if back_a != whole or back_b != whole:
                out = [x if p == q == c else bad for x, p, q, c in zip(out, back_a, back_b, whole)]
            return out

        cache.clear()
        cache[a_key, b_key] = (ChunkedEncoder(learn, most=400_000), inner,
                               np.array([len(x) for x in a_bytes]), np.array([len(x) for x in b_bytes]))
    return cache[a_key, b_key]


def _spaced(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are not empty with a space before them."""
    some = np.diff(starts) > 0
    return np.insert(raw, starts[:-1][some], 0x20), starts + np.concatenate([[0], np.cumsum(some)])


def _whole_rows(encoder: ChunkedEncoder, raw: np.ndarray, starts: np.ndarray):
    """As ``encode_rows``, each row being one chunk."""
    data, edges = raw.tobytes(), starts.tolist()
    found = [encoder.learn([data[i:j].decode()])[0] if j > i else b"" for i, j in zip(edges, edges[1:])]
    return np.frombuffer(b"".join(found), np.int32), np.concatenate([[0], np.cumsum([len(x) >> 2 for x in found])]).astype(np.int64)


def _sides(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """A's ids, their rows' offsets, B's ids and theirs; rows in which a chunk did not come back are empty."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bad = np.zeros(len(offsets) - 1, bool)
    bad[row[flat == -1]] = True
    out = []
    for own in ((flat >= 0) & ~bad[row], (flat < -1) & ~bad[row]):
        out += [flat[own], np.concatenate([[0], np.cumsum(own)])[offsets]]
    return [out[0], out[1], -2 - out[2], out[3]]


def _kind(a_len: np.ndarray, b_len: np.ndarray) -> str:
    """The type of written ids."""
    return "<u2" if max(len(a_len), len(b_len)) <= 1 << 16 else "<i4"


def _blobs(ids: np.ndarray, offsets: np.ndarray, kind: str) -> pa.Array:
    """Rows of ids as bytes."""
    data = ids.astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int32).tobytes()),
                                                                 pa.py_buffer(data.tobytes())])


# ---- alignment --------------------------------------------------------------------------------------------------------

def _digits(most: int) -> np.ndarray:
    """Decimal digits of the numbers up to ``most``, a row each, zero bytes in front."""
    cache = worker_cache("cross_align_digits")
    if len(cache.get("rows", ())) <= most:
        number, width = np.arange(2 * most + 1), len(str(2 * most))
        digit = number[:, None] // 10 ** np.arange(width - 1, -1, -1)
        cache["rows"] = np.where((digit > 0) | (np.arange(width) == width - 1), digit % 10 + 48, 0).astype(np.uint8)
    return cache["rows"]


class Alignment:
    """Links and groups of rows laid end to end; both sides cover the same bytes in each row."""

    def __init__(self, a, a_offsets, b, b_offsets, a_len, b_len):
        self.a, self.b, self.a_offsets, self.b_offsets = a, b, a_offsets, b_offsets
        ends_a, ends_b = np.cumsum(a_len[a]), np.cumsum(b_len[b])
        flags = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.uint8)
        flags[ends_a] |= 1
        flags[ends_b] |= 2
        place = np.flatnonzero(flags)
        flags = flags[place]
        end_a, end_b = (flags & 1).astype(np.int64), (flags >> 1).astype(np.int64)
        self.link_a, self.link_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        both = flags == 3
        before = np.cumsum(both) - both
        self.group_a, self.group_b = before[end_a == 1], before[end_b == 1]
        self.row_a = np.repeat(np.arange(len(a_offsets) - 1), np.diff(a_offsets))
        self.link_row = self.row_a[self.link_a]
        self.n_rows = len(a_offsets) - 1
        self.n_links = np.bincount(self.link_row, minlength=self.n_rows)
        self.group_row = self.link_row[both]
        self.n_groups = np.bincount(self.group_row, minlength=self.n_rows)

    def keys(self) -> np.ndarray:
        return (self.a[self.link_a].astype(np.int64) << 32) | self.b[self.link_b].astype(np.int64)

    def groups(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of each row."""
        many = len(self.group_row)
        n_a, n_b = np.bincount(self.group_a, minlength=many), np.bincount(self.group_b, minlength=many)
        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        at_a = np.arange(len(self.a)) + (upto_b - n_b)[self.group_a]
        at_b = np.arange(len(self.b)) + upto_a[self.group_b]
        value = np.zeros(len(self.a) + len(self.b), np.int32)
        value[at_a], value[at_b] = self.a, self.b
        mark = np.full(len(value), ord(","), np.uint8)
        close = upto_a + upto_b - 1
        mark[close - n_b] = ord("|")
        mark[close] = ord(";")
        last = np.append(self.group_row[1:] != self.group_row[:-1], True)[:many]
        mark[close[last]] = 0  # nothing after a row's last token
        digits = _digits(int(value.max(initial=0)))
        text = np.empty((len(value), digits.shape[1] + 1), np.uint8)
        text[:, :-1] = digits[value]
        text[:, -1] = mark
        shown = text > 0
        size = np.concatenate([[0], np.cumsum(np.count_nonzero(shown, axis=1))])
        tokens = np.bincount(self.group_row, weights=n_a + n_b, minlength=self.n_rows).astype(np.int64)
        offsets = size[np.concatenate([[0], np.cumsum(tokens)])]
        data = text[shown].tobytes()
        return pa.StringArray.from_buffers(self.n_rows, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data))


# ---- minimal perfect hash ----------------------------------------------------------------------------------------------

LEVELS = 40
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _slot(keys: np.ndarray, level: int, size) -> np.ndarray:
    return (mix64(keys.astype(np.uint64) + np.uint64((level + 1) * int(_STEP) % 2**64)) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys.astype(np.uint64) ^ _STEP) % np.uint64(buckets)).astype(np.int64)


def build_bucket(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits end to end, and the distinct ``keys`` in hash order."""
    sizes, bits, placed, rest = [], [], [], keys
    while len(rest):
        if len(sizes) == LEVELS:
            raise ValueError("keys of a minimal perfect hash must be distinct")
        size = 2 * len(rest) + 1
        slot = _slot(rest, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        stays = alone[slot]
        placed.append(rest[stays][np.argsort(slot[stays])])
        rest = rest[~stays]
        sizes.append(size)
        bits.append(alone)
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), np.concatenate(placed) if placed else keys


class PerfectHash:
    """Minimal perfect hash over buckets: ``index`` gives each key's number below the count of keys."""

    def __init__(self, buckets: list[tuple[int, list[int], bytes, bytes]], total: int):
        self.total = total
        self.size = np.zeros((total, LEVELS), np.int64)
        self.base = np.zeros((total, LEVELS), np.int64)
        bits, keys, at = [], [], 0
        for number, sizes, packed, own in sorted(buckets):
            n = sum(sizes)
            self.size[number, :len(sizes)] = sizes
            self.base[number, :len(sizes)] = at + np.cumsum([0, *sizes[:-1]])
            bits.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=n))
            keys.append(np.frombuffer(own, np.int64))
            at += n
        self.bits = np.concatenate(bits) if bits else np.zeros(0, np.uint8)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        # ranks: bits set before each run of 64
        pad = np.append(self.bits, np.zeros(-len(self.bits) % 64, np.uint8)).reshape(-1, 64)
        self.before = np.concatenate([[0], np.cumsum(pad.sum(axis=1, dtype=np.int64))])
        self.words = np.packbits(pad, axis=1, bitorder="little").view("<u8").ravel()
        del self.bits

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1 for keys that were not given (told by the kept keys)."""
        out = np.full(len(keys), -1, np.int64)
        bucket, left = bucket_of(keys, self.total), np.arange(len(keys))
        for level in range(LEVELS):
            size = self.size[bucket[left], level]
            left = left[size > 0]
            if not len(left):
                break
            place = self.base[bucket[left], level] + _slot(keys[left], level, size[size > 0])
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[place >> 6] + below)[hit]
            left = left[~hit]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


def perfect_hash_buckets(keys: DataFrame, buckets: int) -> DataFrame:
    """(bucket, sizes, bits, keys) of the distinct ``key`` rows; a bucket's keys are built in one task."""
    def number(batches):
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(k, buckets)), batch.column(0)], ["bucket", "key"])

    def build(key: tuple, group: pa.Table) -> pa.Table:
        sizes, bits, order = build_bucket(np.sort(group.column("key").to_numpy()))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                         "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "keys": pa.array([order.tobytes()], pa.binary())})

    return (keys.mapInArrow(number, "bucket bigint, key bigint").groupBy("bucket")
            .applyInArrow(build, "bucket bigint, sizes array<bigint>, bits binary, keys binary"))


# ---- count vectors -------------------------------------------------------------------------------------------------------

VECTORS = "block bigint, part bigint, counts binary"


def _packed(v: np.ndarray) -> bytes:
    return pa.compress(v.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd"), "<i8")


def tree_sum(vectors: DataFrame, total: int) -> np.ndarray:
    """The sum of count vectors of ``total`` entries given as blocks by part; at most FAN meet in a task."""
    def add(key: tuple, group: pa.Table) -> pa.Table:
        block = key[0].as_py()
        n = min(BLOCK, total - block * BLOCK)
        out = np.zeros(n, np.int64)
        for blob in group.column("counts").to_pylist():
            out += _unpacked(blob, n)
        return pa.table({"block": pa.array([block], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "counts": pa.array([_packed(out)], pa.binary())})

    while True:
        parts = vectors.agg(F.max("part")).first()[0] or 0
        merged = vectors.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("block", "part").applyInArrow(add, VECTORS)
        vectors = saved(merged, "vectors")
        if parts < FAN:
            break
    out = np.zeros(total, np.int64)
    for r in vectors.collect():  # the sum itself: total entries
        out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = _unpacked(r["counts"], min(BLOCK, total - r["block"] * BLOCK))
    return out


# ---- the operator ----------------------------------------------------------------------------------------------------------

def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          most_keys: int = MOST_KEYS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups`` (``a1,a2|b1;a3|b2,b3``)."""
    spark = df.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))  # vocabulary files: fixed size
    a_key, b_key = f"{a_path}#{os.path.getsize(a_path)}", f"{b_path}#{os.path.getsize(b_path)}"
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                     F.spark_partition_id().alias("part"))

    def encoder():
        vocabulary, model = files.value
        return _encoder(vocabulary, a_key, model, b_key)

    def tokenise(batches):
        chunks, whole, a_len, b_len = encoder()
        kind = _kind(a_len, b_len)
        seen, row = np.zeros(0, np.int64), None

        def pairs_row(keys):
            return pa.RecordBatch.from_arrays(
                [*[pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], pa.array([keys.astype("<i8").tobytes()], pa.binary())],
                ["row", "doc_id", "a", "b", "pairs"])

        for part in slices(batches, "text", 1 << 20):
            if row is None and part.num_rows:
                row = part.column("part")[0].as_py() << 40
            raw, starts = _spaced(*binary_view(part.column("text")))
            a, a_off, b, b_off = _sides(*(_whole_rows(chunks, raw, starts) if whole else chunks.encode_rows(raw, starts)))
            seen = np.union1d(seen, pd.unique(Alignment(a, a_off, b, b_off, a_len, b_len).keys()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row or 0, (row or 0) + part.num_rows)), part.column("doc_id"),
                 _blobs(a, a_off, kind), _blobs(b, b_off, kind), pa.nulls(part.num_rows, pa.binary())], ["row", "doc_id", "a", "b", "pairs"])
            row = (row or 0) + part.num_rows
            if len(seen) > SEEN_KEYS:
                yield pairs_row(seen)
                seen = np.zeros(0, np.int64)
        if len(seen):
            yield pairs_row(seen)

    written = saved(docs.mapInArrow(tokenise, TOKENS), "tokens", compression="zstd")
    rows = written.where("row is not null").select("row", "doc_id", "a", "b", F.spark_partition_id().alias("part"))

    def unpacked(batches):
        for batch in batches:
            for blob in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob.as_py(), "<i8"))], ["key"])

    keys = saved(written.where("pairs is not null").select("pairs").mapInArrow(unpacked, "key bigint").distinct(), "pairs")
    total = keys.count()
    buckets = max(1, -(-total // BUCKET_KEYS))
    built = saved(perfect_hash_buckets(keys, buckets), "hash")
    shards = max(1, -(-total // most_keys))
    spark_ids = len(a_token_bytes(files.value[0]))

    def aligned(batches):
        """Slices of the written rows and their alignments."""
        _, _, a_len, b_len = encoder()
        kind = _kind(a_len, b_len)
        for part in slices(batches, "a", 1 << 19):
            sides = []
            for c in ("a", "b"):
                raw, off = binary_view(part.column(c))
                ids = np.frombuffer(raw.tobytes(), kind)
                sides += [ids.astype(np.int32), off // ids.itemsize]
            yield part, Alignment(*sides, a_len, b_len)

    def shard(k: int):
        """The hash of one shard's buckets, from the written table, broadcast: ``most_keys`` keys, about."""
        own = built.where(F.pmod("bucket", F.lit(shards)) == k).collect()
        return spark.sparkContext.broadcast(PerfectHash([tuple(r) for r in own], buckets))

    def add_up(found):
        def run(batches):
            h, counts, number = found.value, None, 0
            for part, links in aligned(batches):
                if counts is None:
                    counts, number = np.zeros(len(h.keys), np.int64), part.column("part")[0].as_py()
                which, keys = pd.factorize(links.keys())
                if not len(keys):
                    continue
                index = h.index(keys)
                once = pd.unique(links.link_row * len(keys) + which) % len(keys)  # each pair once a document
                docs_with = np.bincount(once, minlength=len(keys))
                counts[index[index >= 0]] += docs_with[index >= 0]
            for block in range(0 if counts is None else -(-len(counts) // BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([number], pa.int64()), pa.array(
                    [_packed(counts[block * BLOCK:(block + 1) * BLOCK])], pa.binary())], ["block", "part", "counts"])

        return run

    best = np.zeros(spark_ids, np.int64)  # the largest count of each A id
    hashes = []
    for k in range(shards):
        found = shard(k)
        n = len(found.value.keys)
        counts = tree_sum(saved(rows.mapInArrow(add_up(found), VECTORS), "vectors"), n)
        np.maximum.at(best, found.value.keys >> 32, counts)
        hashes.append((found, spark.sparkContext.broadcast(counts)))
    best = spark.sparkContext.broadcast(best)

    def look_up(found, counted, whole: bool):
        def run(batches):
            h, counts = found.value, counted.value
            for part, links in aligned(batches):
                which, keys = pd.factorize(links.keys())
                index = h.index(keys)
                own = np.where(index >= 0, counts[np.maximum(index, 0)], 0) if len(counts) else np.zeros(len(keys), np.int64)
                top = (index >= 0) & (own == best.value[keys >> 32])
                sums = np.zeros(links.n_rows, np.int64)
                np.add.at(sums, links.link_row, own[which])
                n_best = np.bincount(links.link_row, weights=top[which], minlength=links.n_rows).astype(np.int64)
                none = np.zeros(links.n_rows, np.int64)
                first = [np.diff(links.a_offsets), np.diff(links.b_offsets), links.n_groups, links.n_links] if whole else [none] * 4
                text = links.groups() if whole else pa.array([""] * links.n_rows, pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *[pa.array(x) for x in (*first, n_best, sums)], text],
                                                 [f.split()[0] for f in RESULT.split(", ")])

        return run

    out = rows.mapInArrow(look_up(*hashes[0], True), RESULT)
    if shards > 1:  # every shard's share of the sums
        for found, counted in hashes[1:]:
            out = out.unionByName(rows.mapInArrow(look_up(found, counted, False), RESULT))
        out = out.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                                               F.max("groups").alias("groups"))
    return out.drop("row")
