"""Repeated byte strings by suffix arrays.

Every byte covered by a ``window``-byte string that starts anywhere else as
well, in this document or another, is removed.  Windows that may be repeated
travel in strings to the bucket of their minimiser (see ``runs``); there the
strings of each minimiser are joined to shards of bounded size, a suffix array
is built by induced sorting, permuted common prefixes are computed, and windows
whose suffixes share ``window`` bytes with a neighbour are repeated.  Strings
that share too little of what stands around their minimiser with any other are
left out of the shards: they hold no repeated window.
Documents with equal texts are settled by their digest.

With ``noted``, a shorter window, the bytes covered by recurring strings of that
length are counted too (and stay).  One pass finds both: the shorter windows'
runs are shipped, each string going on for ``window`` bytes from its last place,
and the permuted common prefixes tell both lengths.

Defined results: null text is the empty text; texts shorter than the window lose
nothing; every row of equal texts is removed whole, repeated rows included; rows
that share an id are documents of their own; a null id is kept; only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs, sais
from .common import binary_view, gathered, mix64, saved, slices

GRAM = 32
SHARD_BYTES = 4 << 20
POOL_BYTES = 4 << 20
SEPARATOR = b"\xff"  # never in UTF-8


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """63-bit hash of the 32 bytes from each position (of whole grams only), by doubling."""
    h, have = raw.astype(np.uint64) + np.uint64(1), 1
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63):
        if len(h) <= have:
            return np.zeros(0, np.uint64)
        h = h[:-have] * np.uint64(factor) + h[have:]
        if have == 4:
            h ^= h >> np.uint64(29)
        have *= 2
    return mix64(h) >> np.uint64(1)


def _windows(window: int):
    def windows(raw: np.ndarray, starts: np.ndarray):
        data = raw.tobytes()
        edges = starts.tolist()
        digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(edges, edges[1:])]
        grams = gram_hashes(raw)
        at, row, least = runs.window_runs(grams, starts[:-1], starts[1:], window, window - GRAM + 1)
        return digests, np.diff(starts), (at, row, least, starts[:-1], grams), lambda a, b: data[a:b]

    return windows


def repeated_windows(texts: list[bytes], places: list[int], lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length, stretches (string's number; first place and end) of a string's first ``places`` places where a
    substring of that length begins that also begins at another such place of any of them.  The strings hold the
    least length from each of these places."""
    joined = np.frombuffer(SEPARATOR.join(texts) + SEPARATOR, np.uint8)
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size + 1) - size - 1
    sa = sais.suffix_array(joined)
    shared = sais.common_prefixes(joined, sa, max(lengths))[sa]
    depth = np.zeros(len(joined) + 1, np.int8)
    depth[first] = 1
    np.subtract.at(depth, first + np.array(places), 1)
    among = np.flatnonzero(np.cumsum(depth)[sa])  # suffixes that begin at such a place
    sa = sa[among]
    least = np.zeros(len(sa), np.int64)
    if len(sa) > 1:  # what it shares with the one before it among these
        least[1:] = np.minimum.reduceat(shared[:among[-1] + 1], among[:-1] + 1)
    left = np.repeat(first + size, size + 1) - np.arange(len(joined))  # bytes of the string from each place on
    out = []
    for length in lengths:
        again = least >= length
        again[:-1] |= again[1:]  # with the one before or the one after
        flags = np.zeros(len(joined), bool)
        flags[sa] = again
        flags &= left >= length
        pairs = runs.as_ranges(flags)
        which = np.searchsorted(first, pairs[:, 0], "right") - 1
        out.append((which, pairs - first[which][:, None]))
    return out


def may_recur(texts: list[bytes], keys: list[int], windows: tuple[int, ...]) -> list[np.ndarray]:
    """For each of ``windows``, whether a string may hold a window that another string of its key, or itself
    elsewhere, holds too.

    A window is the key's gram and ``window - GRAM`` bytes around it.  Cut into grams before and after that one,
    these make ``n`` whole grams at least, wherever it stands: equal windows agree on ``n + 1`` grams in a row, the
    key's among them."""
    joined = np.frombuffer(SEPARATOR.join(texts) + SEPARATOR, np.uint8)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size + 1) - 1
    text = np.repeat(np.arange(len(texts)), size + 1)
    key = (np.array(keys, np.int64) & (2**63 - 1)).astype(np.uint64)
    grams = gram_hashes(joined)
    at = np.flatnonzero(grams == key[text[:len(grams)]])
    who = text[at]
    whole = at + GRAM <= end[who]
    at, who = at[whole], who[whole]
    out = []
    for window in windows:
        n = max(-(-(window - 3 * GRAM + 2) // GRAM), 0)
        some = np.zeros(len(texts), bool)
        for back in range(n + 1):
            first = at - back * GRAM
            inside = (first >= (end - size)[who]) & (first + (n + 1) * GRAM <= end[who])
            first, owner = first[inside], who[inside]
            h = key[owner]
            for k in range(n + 1):
                h = mix64(h + grams[first + k * GRAM])
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            some[owner[order][1:][same]] = some[owner[order][:-1][same]] = True
        out.append(some)
    return out


def _resolve(window: int, longer: int):
    lengths = (window,) if longer == window else (window, longer)

    def resolve(records: list[tuple]) -> list[tuple]:
        by_key: dict[int, dict[tuple[bytes, int], dict]] = {}
        for doc, tie, start, many, key, known, text in records:
            places = by_key.setdefault(key, {}).setdefault((text, many), {})
            places[doc, tie, start] = places.get((doc, tie, start), False) or known
        marks: dict[tuple[int, int, int], list[int]] = {}
        pool, shard = [], []

        def finish():
            found = repeated_windows([t for t, _, _ in shard], [m for _, m, _ in shard], lengths)
            for length, (which, pairs) in zip(lengths, found):
                for i, (a, b) in zip(which.tolist(), pairs.tolist()):
                    for doc, tie, start in shard[i][2]:
                        marks.setdefault((doc, tie, length), []).extend((start + a, start + b))
            shard.clear()

        def sift():
            """Strings of the pool that may hold repeated windows go to shards, those of a key together."""
            size, last = sum(len(t) for t, _, _ in shard), None
            found = may_recur([t for _, t, _, _ in pool], [k for k, *_ in pool], lengths)
            for (key, text, many, places), short, long in zip(pool, found[0].tolist(), found[-1].tolist()):
                if short:
                    if not long:  # only its shorter windows may recur
                        text = text[:many - 1 + window]
                    if size > SHARD_BYTES and key != last:
                        finish()
                        size = 0
                    shard.append((text, many, places))
                    size += len(text)
                    last = key
            pool.clear()

        size = 0
        for key, texts in by_key.items():
            for (text, many), places in texts.items():
                if len(places) > 1:  # equal strings: all their windows are repeated (known ones are marked already)
                    for length in lengths:
                        n = min(many, len(text) - length + 1)
                        for doc, tie, start in places if n > 0 else ():
                            marks.setdefault((doc, tie, length), []).extend((start, start + n))
                # strings settled as a whole stay, for the others to be found by
                pool.append((key, text, many, list(places) if len(places) == 1 and not any(places.values()) else []))
                size += len(text)
            if size > POOL_BYTES:
                sift()
                size = 0
        if pool:
            sift()
        if shard:
            finish()
        return [(*who, np.array(pairs, np.int64)) for who, pairs in marks.items()]

    return resolve


RESULT = "doc_id bigint, tie bigint, n_removed bigint, n_spans bigint, n_noted bigint, kept binary"


def remove_repeats(df: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None,
                   whole_characters: bool = False, noted: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, ``kept`` (binary; null: the whole text), and
``digest``, the text's hexadecimal SHA-256; ``n_noted`` counts the bytes in recurring strings of ``noted`` bytes
    (at most ``window``; by default ``window``).  With ``whole_characters`` a character of which a byte goes goes whole."""
    spark = df.sparkSession
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    noted = min(noted or window, window)
    windows = _windows(noted)
    scanned = runs.scan(docs, windows, noted - GRAM + 1)
    shipped = runs.ship(docs, windows, noted, noted - GRAM + 1, runs.tables(scanned), buckets, later_only=False,
                        reach=window if noted < window else None)

    def cut(batches):
        for batch in slices(batches, "text", 4 << 20):
            raw, starts = binary_view(batch.column("text"))
            rows = []
            for i, (doc, found) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("found").to_pylist())):
                own = raw[starts[i]:starts[i + 1]]
                tie = runs.tie_of(hashlib.sha256(own.tobytes()).hexdigest())
                some, gone = (runs.covered([f["ranges"] for f in found if f["tie"] == tie and f["span"] == span], span, len(own))
                              for span in (noted, window))
                if gone.any() and whole_characters:
                    character = np.cumsum(own & 0xC0 != 0x80) - 1
                    gone = (np.bincount(character, weights=gone) > 0)[character]
                if some.any():
                    rows.append((doc, tie, int(gone.sum()), len(runs.as_ranges(gone)), int(some.sum()), own[~gone].tobytes() if gone.any() else None))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 5, pa.binary()))],
                                             ["doc_id", "tie", "n_removed", "n_spans", "n_noted", "kept"])

    rows = scanned.count()
    texts = runs.marked_texts(docs, runs.marks(shipped, _resolve(noted, window)), rows)
    found = texts.mapInArrow(cut, RESULT).dropDuplicates(["doc_id", "tie"])
    found = found.select(F.col("doc_id").alias("key"), "tie", "n_removed", "n_spans", "n_noted", "kept")
    copies = scanned.where(F.col("n") >= noted).groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1").select("digest")
    copies = saved(gathered(copies, rows), "copies")
    base = scanned.select("doc_id", "tie", "digest", F.col("n").alias("n_bytes"), F.coalesce("doc_id", F.lit(runs.NO_ID)).alias("key"))
    out = base.join(copies.withColumn("copied", F.lit(True)), "digest", "left").join(found, ["key", "tie"], "left")
    copied, size = F.col("copied").isNotNull(), F.col("n_bytes")
    whole = copied & (size >= window)
    kept = F.when(whole, F.lit(b"")).otherwise(F.col("kept"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", "n_bytes", F.when(whole, size).otherwise(count("n_removed")).alias("n_removed"),
                      F.when(whole, F.lit(1)).otherwise(count("n_spans")).cast("bigint").alias("n_spans"),
                      F.when(kept.isNotNull(), F.sha2(kept, 256)).otherwise(F.col("digest")).alias("kept_sha256"), kept.alias("kept"), "digest",
                      F.when(copied, size).otherwise(count("n_noted")).alias("n_noted"))
