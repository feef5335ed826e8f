"""Context-triggered piecewise hashing: fingerprints whose parts survive local edits.

A rolling hash over seven bytes marks chunk ends where ``hash + 1`` is a
multiple of the block size ``3 * 2**k``; each chunk gives one of 64 letters.  A
fingerprint is ``block:signature:signature at twice the block``.  The block is
the least (from a start that follows from the length) that makes at most 64
chunks.  ``likeness`` compares the signatures of equal block sizes, one and
twice: 1 - edit distance / longer length, the best of them, 0 if no block size
is shared.  All bytes count; work goes block by block, so long texts need
bounded memory beyond the text itself.

Defined results: null text is the empty text with fingerprint ``3::``; equal
fingerprints have likeness 1; the next document of ``with_edits`` goes by
ascending id (null first, ties by text), after the last comes the first, a
single document follows itself; only the id and text columns are read there;
``fingerprints`` replaces an input column of the output's name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_view, mix64, set_column, slices, with_field, worker_cache

WINDOW, MOST = 7, 64
BLOCK = 1 << 19
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
BASE = 0x9E3779B97F4A7C15 | 1
WORD = 2**64


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial base and of its inverse (mod 2**64) within a block."""
    cache = worker_cache("ctph")
    if not cache:
        for name, base in (("pow", BASE), ("inv", pow(BASE, -1, WORD))):
            steps = np.full(BLOCK, np.uint64(base))
            steps[0] = 1
            cache[name] = np.multiply.accumulate(steps)
    return cache["pow"], cache["inv"]


def _marks(raw: np.ndarray, starts: np.ndarray, least: np.ndarray):
    """Chunk ends (position after the window, level) and the polynomial prefix sums there and at ``starts``.

    ``starts`` are the row offsets, last one included; ``least`` the lowest level wanted of each row."""
    power, _ = _powers()
    ends, levels, sums_at_end = [], [], []
    sums_at_start = np.zeros(len(starts), np.uint64)
    total = 0
    for b0 in range(0, len(raw), BLOCK):
        b1 = min(b0 + BLOCK, len(raw))
        x = raw[max(0, b0 - WINDOW + 1):b1].astype(np.uint32)
        x = np.concatenate([np.zeros(WINDOW - 1 - min(b0, WINDOW - 1), np.uint32), x])
        n = b1 - b0
        plain = np.zeros(n, np.uint32)
        weighted = np.zeros(n, np.uint32)
        shifted = np.zeros(n, np.uint32)
        for k in range(WINDOW):  # k bytes back
            part = x[WINDOW - 1 - k:WINDOW - 1 - k + n]
            plain += part
            weighted += part * np.uint32(WINDOW - k)
            shifted ^= part << np.uint32(5 * k)
        roll = plain + weighted + shifted + np.uint32(1)
        third = roll // np.uint32(3)
        at = np.flatnonzero((third * np.uint32(3) == roll) & (roll > 0))
        value = third[at]
        level = np.bitwise_count((value & (~value + np.uint32(1))) - np.uint32(1)).astype(np.int64)
        pos = at + b0
        row = np.searchsorted(starts, pos, side="right") - 1
        keep = (level >= least[row]) & (pos - starts[row] >= WINDOW - 1)
        scale = np.uint64(pow(BASE, b0, WORD))
        prefix = np.cumsum((raw[b0:b1].astype(np.uint64) + np.uint64(1)) * power[:n] * scale, dtype=np.uint64) + np.uint64(total)
        ends.append(pos[keep] + 1)
        levels.append(level[keep])
        sums_at_end.append(prefix[at[keep]])
        own = np.flatnonzero((starts > b0) & (starts <= b1))
        sums_at_start[own] = prefix[starts[own] - b0 - 1]
        total = int(prefix[-1])
    cat = [np.concatenate(v) if v else np.zeros(0, t) for v, t in ((ends, np.int64), (levels, np.int64), (sums_at_end, np.uint64))]
    return (*cat, sums_at_start)


def _letters(starts, ends, sums_at_start, sums_at_end) -> tuple[bytes, np.ndarray]:
    """The letters of all rows' chunks in order, and the rows' offsets into them."""
    _, inverse = _powers()
    edge = np.concatenate([starts, ends])
    sums = np.concatenate([sums_at_start, sums_at_end])
    edge, first = np.unique(edge, return_index=True)
    sums = sums[first]
    scale = inverse[edge[:-1] % BLOCK]
    blocks = edge[:-1] // BLOCK
    if len(blocks) and blocks[-1]:
        step = pow(BASE, -BLOCK, WORD)
        table = np.array([pow(step, int(b), WORD) for b in range(int(blocks[-1]) + 1)], np.uint64)
        scale = scale * table[blocks]
    letter = LETTERS[(mix64((sums[1:] - sums[:-1]) * scale) >> np.uint64(58)).astype(np.int64)]
    return letter.tobytes(), np.searchsorted(edge, starts)


def fingerprint_rows(raw: np.ndarray, starts: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """(level, signature, signature at the next level) of each row of concatenated texts."""
    rows = len(starts) - 1
    size = np.diff(starts)
    least = np.maximum(np.floor(np.log2(np.maximum(size, 1) / (3 * MOST))).astype(np.int64) - 4, 0)
    ends, levels, sums_at_end, sums_at_start = _marks(raw, starts, np.append(least, 99))
    row = np.searchsorted(starts, ends - 1, side="right") - 1
    inner = ends < starts[row + 1]  # an end at the text's end makes no further chunk
    counts = np.bincount(row[inner] * 33 + levels[inner], minlength=rows * 33)[:rows * 33].reshape(rows, 33)
    at_least = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    fits = (at_least <= MOST - 1) & (np.arange(33) >= least[:, None])
    chosen = fits.argmax(axis=1)  # level 32 always fits
    out = []
    for more in (0, 1):
        sel = levels >= chosen[row] + more
        out.append(_letters(starts, ends[sel], sums_at_start, sums_at_end[sel]))
    (one, a), (two, b) = out
    return [(int(k), one[a[i]:a[i + 1]], two[b[i]:b[i + 1]]) for i, k in enumerate(chosen)]


def _text(found: list[tuple[int, bytes, bytes]]) -> list[str]:
    return [f"{3 << k}:{a.decode()}:{b.decode()}" for k, a, b in found]


def _edit_distance(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Levenshtein distance of each pair of strings of at most 64 bytes, bit-parallel over all pairs."""
    n = len(a)
    ma = np.frombuffer(b"".join([x.ljust(64, b"\0") for x in a]), np.uint8).reshape(n, 64)
    mb = np.frombuffer(b"".join([x.ljust(64, b"\1") for x in b]), np.uint8).reshape(n, 64)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    one = np.uint64(1)
    plus, minus, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), la.copy()
    last = one << np.maximum(la - 1, 0).astype(np.uint64)
    for j in range(int(lb.max(initial=0))):
        same = np.packbits(ma == mb[:, j:j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up, down = minus | ~(diagonal | plus), plus & diagonal
        live = j < lb
        score += live & ((up & last) != 0)
        score -= live & ((down & last) != 0)
        up, down = (up << one) | one, down << one
        plus, minus = np.where(live, down | ~(diagonal | up), plus), np.where(live, up & diagonal, minus)
    return np.where(la == 0, lb, score)


def likeness_rows(a: list[tuple[int, bytes, bytes]], b: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Likeness (0 to 1) of each pair of (level, signature, next signature)."""
    at, left, right = [], [], []
    for i, ((k, a1, a2), (m, b1, b2)) in enumerate(zip(a, b)):
        pairs = ((a1, b1), (a2, b2)) if k == m else ((a2, b1),) if m == k + 1 else ((a1, b2),) if k == m + 1 else ()
        for x, y in pairs:
            if x and y:
                at.append(i)
                left.append(x)
                right.append(y)
    best = np.zeros(len(a))
    if at:
        longer = np.array([max(len(x), len(y)) for x, y in zip(left, right)])
        np.maximum.at(best, at, 1 - _edit_distance(left, right) / longer)
    best[[x == y for x, y in zip(a, b)]] = 1.0
    return best


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of every whole text."""

    def run(batches):
        for batch in slices(batches, text_col):
            found = fingerprint_rows(*binary_view(batch.column(batch.schema.names.index(text_col))))
            yield set_column(batch, out_col, pa.array(_text(found), pa.string()))

    return df.mapInArrow(run, with_field(df.schema, out_col, T.StringType()))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null if one is null."""

    def parts(text: str) -> tuple[int, bytes, bytes]:
        block, one, two = text.split(":")
        return (int(block) // 3).bit_length() - 1, one.encode(), two.encode()

    @F.arrow_udf("double")
    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        x, y = x.to_pylist(), y.to_pylist()
        both = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
        out = [None] * len(x)
        for i, v in zip(both, likeness_rows([parts(x[i]) for i in both], [parts(y[i]) for i in both])):
            out[i] = float(v)
        return pa.array(out, pa.float64())

    return compare(a, b)


EDITS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double")


def _byte_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=starts[1:])
    return np.frombuffer(b"".join(raw), np.uint8), starts


def _edit(text: str, following: str) -> str:
    tail = len(text) // 4
    return text[:len(text) - tail] + following[:tail]


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each document against its next one and against itself with the last quarter taken from the next.

    The ids alone are range-partitioned first; the least id of each range (as many as ranges) fixes the
    ranges and tells which rows the range before needs as well, so texts are shuffled once."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-2**63))
    lows = (rows.select(order.alias("k")).repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("p"))
            .agg(F.min("k").alias("low")).collect())
    lows = np.array(sorted(r["low"] for r in lows), np.int64)
    if not len(lows):
        return spark.createDataFrame([], EDITS)

    @F.arrow_udf("array<int>")
    def places(k: pa.Array) -> pa.Array:
        k = k.to_numpy(zero_copy_only=False)
        own = np.searchsorted(lows, k, side="right") - 1
        return pa.array([[p, -1 - (p - 1) % len(lows)] if head else [p] for p, head in
                         zip(own.tolist(), (lows[own] == k).tolist())], pa.list_(pa.int32()))

    dealt = rows.withColumn("place", F.explode(places(order)))  # -1 - p: to be looked at by range p only
    part = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    dealt = (dealt.repartitionById(len(lows), part)
             .sortWithinPartitions(F.col("place") < 0, F.col("doc_id").asc_nulls_first(), "text"))

    def finish(ids, texts):
        """Results of all but the last of consecutive documents."""
        edited = [_edit(a, b) for a, b in zip(texts, texts[1:])]
        own, changed = fingerprint_rows(*_byte_rows(texts)), fingerprint_rows(*_byte_rows(edited))
        cols = [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(_text(own[:-1])),
                pa.array(_text(changed)), pa.array(likeness_rows(own[:-1], changed)), pa.array(likeness_rows(own[:-1], own[1:]))]
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in EDITS.split(", ")])

    def run(batches):
        ids, texts, seen_next = [], [], False
        for batch in slices(batches, "text"):
            for i, t, place in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "place"))):
                if place >= 0 or not seen_next:
                    ids.append(i)
                    texts.append(t)
                    seen_next = place < 0
            if len(ids) > 1:
                yield finish(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    return dealt.mapInArrow(run, EDITS)
