"""Repeated windows over all documents: runs of windows that share a minimiser travel to its bucket.

Both substring operators use this frame; they differ in what a window is made
of and in how a bucket finds its repeated windows.

1. ``scan``: per document, a digest of its content and the runs of consecutive
   windows with one minimiser (the least hash of the grams in a window).
2. ``tables``: the minimisers that occur at two places or more, and those that
   occur very often, as bit tables of bounded size.  Windows whose minimiser is
   not repeated cannot be repeated and are never shipped; in windows whose
   minimiser is very frequent, frequent grams are passed over in favour of
   others, which spreads what a common passage would send to one bucket.
3. ``ship``: runs become packed strings (content once per slice of input, equal
   ones are settled there) that go to their minimiser's bucket, compressed.
4. ``resolve`` (by the operator) marks windows in each bucket.

Equal windows have equal minimisers, so they meet in a bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_view, bit_words, gathered, in_bits, listed, mix64, saved, slices, sliding_min, table_bits

NO_ID = -(2**63)  # stands for a null id inside the operators
HOT_RUNS = 2000  # a minimiser with more runs is frequent
FLUSH_BYTES = 16 << 20
TOP = np.uint64(1 << 63)

SCAN = "row bigint, doc_id bigint, tie bigint, digest string, n bigint, mins array<bigint>, starts array<bigint>"
SHIPPED = "bucket int, blob binary, doc_id bigint, tie bigint, span int, ranges binary"
MARKS = "doc_id bigint, tie bigint, span int, ranges binary"  # span: the length of the marked windows


def tie_of(digest: str) -> int:
    """The first 63 bits of a hexadecimal digest."""
    return int(digest[:16], 16) >> 1


def window_runs(grams: np.ndarray, first: np.ndarray, end: np.ndarray, window: int, per_window: int):
    """Windows of rows laid end to end: ``grams`` hashes of the grams starting at each position, ``first``/``end``
    the rows' positions.  Gives the windows' positions, their rows and their least gram."""
    n = np.maximum(end - first - window + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[row]
    least = sliding_min(grams, per_window)[at] if len(at) else np.zeros(0, np.uint64)
    return at, row, least


def recurs(grams: np.ndarray, at: np.ndarray, least: np.ndarray, cut: np.ndarray, per_window: int) -> np.ndarray:
    """For each run (beginning at ``cut``), whether its minimiser stands at two places or more within it,
    so that the run may hold equal windows itself (periodic text)."""
    if not len(cut):  # no text is as long as a window
        return np.zeros(0, bool)
    m = np.zeros(len(grams) + per_window - 1, np.uint64)
    m[at + per_window - 1] = least
    places = np.flatnonzero(grams == sliding_min(m, per_window, np.maximum))
    value = grams[places]
    last = np.append(cut[1:], len(at)) - 1
    lo, hi = np.searchsorted(places, at[cut]), np.searchsorted(places, at[last] + per_window)
    seen, live = np.zeros(len(cut), np.int64), np.flatnonzero(lo < hi)
    while len(live):
        seen[live] += value[lo[live]] == least[cut[live]]
        lo[live] += 1
        live = live[(lo[live] < hi[live]) & (seen[live] < 2)]
    return seen > 1


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def scan(docs: DataFrame, windows: Callable, per_window: int) -> DataFrame:
    """One row per document; ``windows(raw, starts)`` gives digests, sizes, (position, row, least gram, rows'
    first positions, grams) of the operator's windows, and a function for the string between two positions."""

    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            digests, size, (at, row, least, first, grams), _ = windows(*binary_view(batch.column(2)))
            cut = _cuts(row, least)
            seen = set()
            fresh = [not (d in seen or seen.add(d)) for d in digests]  # equal contents: once per slice
            keep = np.array(fresh, bool)[row[cut]] if len(cut) else np.zeros(0, bool)
            twice = recurs(grams, at, least, cut, per_window)
            more = cut[keep & twice]
            cut = cut[keep]
            # a run that may repeat itself counts as a second place
            who, mins = np.append(row[cut], row[more]), np.append(least[cut], least[more])
            places = np.append(at[cut] - first[row[cut]], -1 - at[more] + first[row[more]])
            order = np.argsort(who, kind="stable")
            offsets = np.searchsorted(who[order], np.arange(len(digests) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[order].astype(np.int64))) for x in (mins, places)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([tie_of(d) for d in digests], pa.int64()),
                                              pa.array(digests, pa.string()), pa.array(size, pa.int64()), *lists], [f.split()[0] for f in SCAN.split(", ")])

    return saved(docs.mapInArrow(run, SCAN), "scan")


def tables(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """Bit tables of repeated minimisers and (None if there are none) of frequent ones."""
    runs = scanned.select("tie", F.explode(F.arrays_zip("mins", "starts")).alias("x")).select(
        F.col("x.mins").alias("h"), F.xxhash64("tie", "x.starts").alias("place"))
    found = runs.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("n")).where("a < b")
    found = saved(gathered(found.select("h", "n"), scanned.count()), "minimisers")
    hot = found.where(F.col("n") > HOT_RUNS)
    out = []
    for some in (found, hot):
        n = some.count()
        out.append(bit_words(some, table_bits(n)).view(np.uint64) if n else None)
    return (out[0] if out[0] is not None else np.zeros(1024, np.uint64)), out[1]


def pack(record: list[tuple]) -> bytes:
    """(doc_id, tie, start, windows, key, known, content) records as one compressed string."""
    doc, tie, start, many, key, known, content = zip(*record)
    data = pickle.dumps((np.array(doc, np.int64), np.array(tie, np.int64), np.array(start, np.int64), np.array(many, np.int64),
                         np.array(key, np.int64), np.array(known, bool), np.array([len(c) for c in content], np.int64), b"".join(content)))
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[tuple]:
    data = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    doc, tie, start, many, key, known, size, content = pickle.loads(data)
    ends = np.cumsum(size).tolist()
    return list(zip(doc.tolist(), tie.tolist(), start.tolist(), many.tolist(), key.tolist(), known.tolist(),
                    [content[a:b] for a, b in zip([0, *ends], ends)]))


def ship(docs: DataFrame, windows: Callable, window: int, per_window: int, found: tuple, buckets: int,
         later_only: bool, reach: int | None = None) -> DataFrame:
    """Packed runs by bucket, and (bucket null) what equal runs of a slice settle already.

    With ``later_only`` the first of equal runs is not marked for the others' sake; else all are.  With ``reach``,
    a longer window, strings go on so that each of a run's places has that many positions, if its row has them."""
    repeated, hot = (docs.sparkSession.sparkContext.broadcast(x) for x in found)  # 2 MB at most each

    def run(batches):
        waiting: dict[int, list] = {}
        size = 0

        def flush():
            rows = [(b, pack(r), None, None, None, None) for b, r in sorted(waiting.items())]
            waiting.clear()
            return rows

        for batch in slices(batches, "text", 2 << 20):
            digests, length, (at, row, least, first, grams), content = windows(*binary_view(batch.column(2)))
            ids = [NO_ID if i is None else i for i in batch.column(1).to_pylist()]
            ties = [tie_of(d) for d in digests]
            seen: dict = {}
            for r in sorted(range(len(ids)), key=lambda r: (ids[r], ties[r], r)):
                seen.setdefault(digests[r], r)
            own = np.zeros(len(ids), bool)  # of equal contents, the first
            own[list(seen.values())] = True
            cut = _cuts(least)
            send = np.repeat(in_bits(repeated.value, least[cut]), np.diff(np.append(cut, len(least)))) & own[row]
            at, row, key = at[send], row[send], least[send]
            if hot.value is not None and len(at):
                grams = np.where(in_bits(hot.value, grams), grams | TOP, grams)
                key = sliding_min(grams, per_window)[at]
            cut = _cuts(row, key, at - np.arange(len(at)))
            many = np.diff(np.append(cut, len(at)))
            stop = at[cut] + many - 1 + window
            if reach:
                stop = np.minimum(stop + reach - window, (first + length)[row[cut]])
            local: dict[tuple[bytes, int], list] = {}
            key = key[cut]
            dealt = (mix64(key) % np.uint64(buckets)).tolist()
            begin = (at[cut] - first[row[cut]]).tolist()
            for a, e, r, k, m, p, b in zip(at[cut].tolist(), stop.tolist(), row[cut].tolist(), key.view(np.int64).tolist(), many.tolist(), begin, dealt):
                local.setdefault((content(a, e), m), []).append((ids[r], ties[r], p, m, k, b))
            settled: dict[tuple[int, int, int], list[int]] = {}
            for (text, m), places in local.items():
                places.sort()
                for doc, tie, start, *_ in places[1 if later_only else 0:] if len(places) > 1 else []:
                    settled.setdefault((doc, tie, window), []).extend((start, start + m))
                    if reach and len(text) >= reach:
                        settled.setdefault((doc, tie, reach), []).extend((start, start + min(m, len(text) - reach + 1)))
                *place, bucket = places[0]
                waiting.setdefault(bucket, []).append((*place, len(places) > 1, text))
                size += len(text)
            rows = [(None, None, *who, np.array(pairs, np.int64).tobytes()) for who, pairs in settled.items()]
            if size > FLUSH_BYTES:
                rows, size = rows + flush(), 0
            yield _batch(rows)
        yield _batch(flush())

    return saved(docs.mapInArrow(run, SHIPPED), "shipped")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["bucket", "blob", "doc_id", "tie", "span", "ranges"])


def marks(shipped: DataFrame, resolve: Callable) -> DataFrame:
    """(doc_id, tie, span, ranges) of marked windows: ``resolve(records)`` gives (doc_id, tie, span, int64 pairs)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        records = [r for blob in group.column("blob").to_pylist() for r in unpack(blob)]
        found = resolve(records)
        return pa.Table.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                                     pa.array([f[2] for f in found], pa.int32()),
                                     pa.array([f[3].tobytes() for f in found], pa.binary())], ["doc_id", "tie", "span", "ranges"])

    there = shipped.where("bucket is null").select("doc_id", "tie", "span", "ranges")
    return shipped.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(run, MARKS).unionByName(there)


def marked_texts(docs: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, found) of the documents (``rows`` in all) with marks; ``found`` lists (tie, span, ranges)."""
    found = saved(gathered(found, rows), "marks")
    by_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("tie", "span", "ranges")).alias("found"))
    wanted = found.select(F.xxhash64("doc_id").alias("h")).distinct()
    some = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    return listed(some, F.xxhash64("doc_id"), wanted, wanted.count()).join(by_doc, "doc_id")


def as_ranges(flags: np.ndarray) -> np.ndarray:
    """Pairs (first, end) of the runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1).astype(np.int64)


def covered(ranges: list[bytes], window: int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a marked window."""
    pairs = np.frombuffer(b"".join(ranges), np.int64).reshape(-1, 2)
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, pairs[:, 0], 1)
    np.add.at(depth, pairs[:, 1] - 1 + window, -1)
    return np.cumsum(depth)[:size] > 0
