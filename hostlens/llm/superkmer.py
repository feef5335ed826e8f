"""Repeated word windows by super-k-mer partitioning.

Every word covered by a window of ``window`` consecutive words whose sequence
also starts earlier (a smaller id, or the same document further left) is
removed.  Consecutive windows that share a minimiser travel as one packed string
to its bucket (see ``runs``); there all windows are sorted and each sequence's
first place is found exactly: words are numbered by a dictionary, windows are
sorted by a hash of their numbers and equal hashes are compared word by word.

Words are runs without ASCII white space, unchanged.  Defined results: null and
empty texts have no words and keep the empty text; texts of fewer words than the
window lose nothing; a null id comes before all others; rows that share an id go
by the digest of their words, of equal rows one is the first and the rest are
removed whole; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .common import gathered, hashed_words, mix64, saved, slices

GRAM = 4
SHARD_BYTES = 8 << 20


def _windows(window: int):
    def windows(raw: np.ndarray, starts: np.ndarray):
        data = raw.tobytes()
        begin, end, row, word = hashed_words(raw, starts)
        n = np.bincount(row, minlength=len(starts) - 1)
        first = np.cumsum(n) - n
        two = mix64(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])
        grams = mix64(two[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + two[2:]) >> np.uint64(1)
        at, row, least = runs.window_runs(grams, first, first + n, window, window - GRAM + 1)
        edges = starts.tolist()
        digests = [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest() for a, b in zip(edges, edges[1:])]
        return digests, n, (at, row, least, first, grams), lambda a, b: b" ".join(data[begin[a]:end[b - 1]].split())

    return windows


def later_windows(texts: list[tuple[bytes, tuple[int, int, int]]], window: int) -> list[np.ndarray]:
    """For each (words, place of its first word), which windows have a sequence that also starts earlier."""
    words = [t.split(b" ") for t, _ in texts]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    size = np.array([len(ws) for ws in words])
    n = size - window + 1
    text = np.repeat(np.arange(len(texts)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = inner + (np.cumsum(size) - size)[text]
    h, have = mix64(ids.astype(np.uint64) + np.uint64(1)), 1
    while have < window:
        step = min(have, window - have)
        h = mix64(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:] + np.uint64(have))
        have += step
    h = h[at]
    doc, tie, start = (np.array([p[k] for _, p in texts], np.int64)[text] for k in range(3))
    order = np.lexsort((start + inner, tie, doc, h))
    sorted_h, place = h[order], at[order]
    same = np.zeros(len(order), bool)
    same[1:] = sorted_h[1:] == sorted_h[:-1]
    where = np.flatnonzero(same)
    for k in range(window):
        if (ids[place[where] + k] != ids[place[where - 1] + k]).any():  # unequal windows of one hash: by their words
            first: dict[tuple, int] = {}
            best = np.lexsort((start + inner, tie, doc))
            same = np.array([first.setdefault(tuple(ids[at[i]:at[i] + window].tolist()), i) != i for i in best.tolist()], bool)
            order = best
            break
    flags = np.zeros(len(order), bool)
    flags[order] = same
    return np.split(flags, np.cumsum(n)[:-1])


def _resolve(window: int):
    def resolve(records: list[tuple]) -> list[tuple]:
        by_key: dict[int, dict[bytes, set]] = {}
        for doc, tie, start, _, key, _, text in records:
            by_key.setdefault(key, {}).setdefault(text, set()).add((doc, tie, start))
        out, shard, size = [], [], 0

        def finish():
            for (_, (doc, tie, start)), flags in zip(shard, later_windows(shard, window)):
                if flags.any():
                    out.append((doc, tie, window, runs.as_ranges(flags) + start))
            shard.clear()

        for texts in by_key.values():
            for text, places in texts.items():
                places = sorted(places)
                whole = np.array([[0, text.count(b" ") + 2 - window]], np.int64)
                out += [(doc, tie, window, whole + start) for doc, tie, start in places[1:]]  # all windows start earlier too
                shard.append((text, places[0]))
                size += len(text)
            if size > SHARD_BYTES:
                finish()
                size = 0
        if shard:
            finish()
        return out

    return resolve


RESULT = "doc_id bigint, tie bigint, n_removed bigint, kept binary"


def remove_later_windows(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and ``kept`` (binary; null: all words)."""
    spark = df.sparkSession
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    windows = _windows(window)
    scanned = runs.scan(docs, windows, window - GRAM + 1)
    shipped = runs.ship(docs, windows, window, window - GRAM + 1, runs.tables(scanned), buckets, later_only=True)

    def cut(batches):
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
                words = text.encode().split()
                tie = runs.tie_of(hashlib.sha256(b" ".join(words)).hexdigest())
                gone = runs.covered([f["ranges"] for f in found if f["tie"] == tie], window, len(words))
                if gone.any():
                    rows.append((doc, tie, int(gone.sum()), b" ".join(compress(words, (~gone).tolist()))))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             ["doc_id", "tie", "n_removed", "kept"])

    rows = scanned.count()
    texts = runs.marked_texts(docs, runs.marks(shipped, _resolve(window)), rows)
    found = texts.mapInArrow(cut, RESULT).dropDuplicates(["doc_id", "tie"])
    found = found.select(F.col("doc_id").alias("key"), "tie", "n_removed", "kept")
    # of documents with equal words the first keeps what the others lose
    firsts = scanned.where(F.col("n") >= window).groupBy("digest").agg(
        F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", F.col("first.row").alias("first"))
    firsts = saved(gathered(firsts, rows), "firsts")
    base = scanned.select("row", "doc_id", "tie", "digest", F.col("n").alias("n_words"), F.coalesce("doc_id", F.lit(runs.NO_ID)).alias("key"))
    out = base.join(firsts, "digest", "left").join(found, ["key", "tie"], "left")
    whole, some = F.coalesce(F.col("first") != F.col("row"), F.lit(False)), F.col("n_removed").isNotNull()
    kept = F.when(whole, F.lit(b"")).when(some, F.col("kept"))
    return out.select("doc_id", "n_words", F.when(whole, F.col("n_words")).when(some, F.col("n_removed")).otherwise(F.lit(0)).alias("n_removed"),
                      F.when(whole | some, F.sha2(kept, 256)).otherwise(F.col("digest")).alias("kept_sha256"), kept.alias("kept"))
