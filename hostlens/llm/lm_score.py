"""Cross-entropy difference of two matched word-bigram models.

The background model counts every document, the target model those named in the
labels; order, smoothing and vocabulary are shared.  Every word and pair counts,
so the models grow with the documents, and no model is collected: a slice
of documents sends its distinct words and pairs with their numbers to
buckets of the key space, a bucket adds them up and answers each slice with the
totals, written as a table; the slice scores its texts with the answers.  A
slice sends a key once, so a frequent key costs its bucket one number a slice.
Slices send at most one message a key and bucket, so messages never outnumber the
rows of a plain aggregate by slice.  Keys are 63-bit hashes.

On request the models are cut: the vocabulary then holds the words with at least
``word_share`` of all words, the rest is one unknown word; pairs with at least
``pair_share`` of all adjacent pairs keep counts of their own, the others fall
back on single words.  This bounds what scoring needs, at most ``1 / word_share``
words and ``1 / pair_share`` pairs, which are broadcast; it costs the rare words.

    p(w)     = (c(w) + 1) / (N + V)
    p(w | v) = (c(v w) + m p(w)) / (c(v .) + m)

A document's losses are the means of -ln p over its words (the first by p(w)),
its score is the target's loss less the background's.

Words are runs without ASCII white space, A-Z lower-cased.  Defined results: null
and empty texts have no words and null losses and score; without target
documents the target model is uniform; repeated rows count as often as they
occur; rows of equal id are scored by their own text; a null id is never a
target; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary_view, hashed_words, mix64, saved, slices

BROADCAST_LABELS = 1_000_000
RESULT = "doc_id bigint, n_words bigint, target_loss double, background_loss double, score double"


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word of the text column."""
    raw, starts = binary_view(batch.column(1))
    _, _, row, word = hashed_words(LOWER[raw], starts)
    return row, word.view(np.int64)


GATHERED = 3_000_000  # keys counted together before the shuffle


def _gathered(batches, keys_of):
    """Counts of the keys of many slices at a time; ``keys_of(batch)`` gives keys and their rows."""
    keys, own, many = [], [], 0
    for batch in slices(batches, "text", 2 << 20):
        key, row = keys_of(batch)
        keys.append(key)
        own.append(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int8)[row])
        many += len(key)
        if many > GATHERED:
            yield _counted(np.concatenate(keys), np.concatenate(own))
            keys, own, many = [], [], 0
    if keys:
        yield _counted(np.concatenate(keys), np.concatenate(own))


def _counted(keys: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    """Distinct keys with their numbers in all and in target documents."""
    key, at = np.unique(keys, return_inverse=True)
    own = np.bincount(at, weights=target, minlength=len(key)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at, minlength=len(key))), pa.array(own)], ["k", "b", "t"])


COUNTS = "k bigint, b bigint, t bigint"


def _numbered(word: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted vocabulary; its length for unknown ones."""
    if not len(vocabulary):
        return np.zeros(len(word), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
    return np.where(vocabulary[at] == word, at, len(vocabulary))


def _pairs(row: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of adjacent pairs within a row, and the places of their second words."""
    second = np.flatnonzero(row[1:] == row[:-1]) + 1
    return number[second - 1] * size + number[second], second


def _collected(counts: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Keys with at least ``share`` of all (at most 1 / share of them), their counts, and the totals."""
    total = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    kept = counts.where(F.col("b") >= share * total[0]).toPandas().sort_values("k")
    return kept["k"].to_numpy(np.int64), kept[["b", "t"]].to_numpy(np.int64), int(total[0]), int(total[1])


def scores(df: DataFrame, targets: DataFrame, word_share: float = 0.0, pair_share: float = 0.0, smoothing: float = 100.0,
           id_col: str = "doc_id", text_col: str = "text", target_col: str = "doc_id") -> DataFrame:
    """Losses and score of every row; ``targets`` names the target documents by id.  Shares above 0 cut the models."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = targets.select(F.col(target_col).cast("bigint").alias("doc_id")).where("doc_id is not null").distinct().withColumn("own", F.lit(True))
    if named.count() <= BROADCAST_LABELS:
        named = F.broadcast(named)
    flagged = docs.join(named, "doc_id", "left").select("doc_id", "text", F.coalesce("own", F.lit(False)).alias("own"))

    if word_share <= 0 and pair_share <= 0:
        return _whole_scores(flagged, smoothing)

    def count_words(batches):
        yield from _gathered(batches, lambda batch: _words(batch)[::-1])

    def totals(counted: DataFrame, name: str) -> DataFrame:
        return saved(counted.groupBy("k").agg(F.sum("b").alias("b"), F.sum("t").alias("t")), name)

    words = totals(flagged.mapInArrow(count_words, COUNTS), "words")
    vocabulary, count, n_b, n_t = _collected(words, word_share)
    size = len(vocabulary) + 1
    single = np.append(count, [[n_b - count[:, 0].sum(), n_t - count[:, 1].sum()]], axis=0).astype(float)
    single = (single + 1) / (np.array([n_b, n_t]) + size)
    shipped = spark.sparkContext.broadcast(vocabulary)  # at most 1 / word_share numbers

    def count_pairs(batches):
        def keys_of(batch):
            row, word = _words(batch)
            key, second = _pairs(row, _numbered(word, shipped.value), size)
            return key, row[second]

        yield from _gathered(batches, keys_of)

    pairs = totals(flagged.mapInArrow(count_pairs, COUNTS), "pairs")
    pair, count, _, _ = _collected(pairs, pair_share)
    context = np.stack([np.bincount(pair // size, weights=count[:, x], minlength=size) for x in (0, 1)], axis=1)
    model = spark.sparkContext.broadcast((pair, count, context, single))  # at most 1 / pair_share pairs

    def score(batches):
        pair, count, context, single = model.value
        for batch in slices(batches, "text", 2 << 20):
            row, word = _words(batch)
            number = _numbered(word, shipped.value)
            key, second = _pairs(row, number, size)
            p = single[number]
            if len(second):
                v = number[second - 1]
                at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
                seen = np.where((pair[at] == key)[:, None], count[at], 0) if len(pair) else np.zeros((len(key), 2))
                p[second] = (seen + smoothing * p[second]) / (context[v] + smoothing)
            n = np.bincount(row, minlength=batch.num_rows)
            loss = [np.bincount(row, weights=-np.log(p[:, x]), minlength=batch.num_rows) / np.maximum(n, 1) for x in (1, 0)]
            none = n == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64))] + [pa.array(x, pa.float64(), mask=none) for x in (
                loss[0], loss[1], loss[0] - loss[1])], ["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return docs.mapInArrow(score, RESULT)


SLICE_BYTES = 5 << 19  # text of a slice
BUCKET_BYTES = 4 << 20  # text per bucket of the key space
ANSWERS = "slice bigint, bucket bigint, counts binary, n_words bigint, b bigint, t bigint"
_ONE = np.uint64(1)
_FIRST = np.uint64(0xA0761D6478BD642F)


def _packed(values: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, compressed, after the number of values."""
    raw = values.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes, kind, width: int = 1) -> np.ndarray:
    size, n = np.dtype(kind).itemsize * width, int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], size * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n, width)


def _slice_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words; places of the pairs' second words; keys of words and pairs, and the place of each in them."""
    rows, words, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for batch in slices(table.to_batches(), "text", 1 << 19):
        row, word = _words(batch)
        rows.append(row + n)
        words.append(word)
        n += batch.num_rows
    row, word = np.concatenate(rows), np.concatenate(words).view(np.uint64)
    second = np.flatnonzero(row[1:] == row[:-1]) + 1
    pair = mix64(mix64(word[second - 1] ^ _FIRST) + word[second])
    keys = np.concatenate([word | _ONE, pair & ~_ONE])  # the last bit tells words
    key, at = np.unique(keys, return_inverse=True)
    return row, second, key, at


def _whole_scores(flagged: DataFrame, smoothing: float) -> DataFrame:
    """Scores by the counts of all words and pairs; ``flagged`` has doc_id, text, own."""
    size = flagged.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, buckets = size // SLICE_BYTES + 1, size // BUCKET_BYTES + 1
    docs = flagged.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))

    def send(table):
        row, second, key, at = _slice_keys(table)
        own = table.column("own").to_numpy()[np.concatenate([row, row[second]])].astype(float)
        first, n = at[second - 1], len(key)  # each pair's first word
        counts = np.stack([np.bincount(at, minlength=n), np.bincount(at, weights=own, minlength=n), np.bincount(first, minlength=n),
                           np.bincount(first, weights=own[second - 1], minlength=n)], axis=1).astype(np.int64)
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        there = np.unique(bucket)
        cuts = np.searchsorted(bucket, np.append(there, buckets))
        spans = list(zip(cuts, cuts[1:]))
        return pa.table({
            "slice": pa.array(np.full(len(there), table.column("slice")[0].as_py())), "bucket": pa.array(there),
            "keys": pa.array([_packed(np.diff(key[a:e], prepend=np.uint64(0))) for a, e in spans], pa.binary()),
            "counts": pa.array([_packed(counts[a:e]) for a, e in spans], pa.binary())})

    def answer(table):
        keys = [np.cumsum(_unpacked(x, np.uint64)[:, 0], dtype=np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([_unpacked(x, np.int64, 4) for x in table.column("counts").to_pylist()])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.stack([np.bincount(at, weights=counts[:, x], minlength=len(key)) for x in range(4)], axis=1).astype(np.int64)
        word = key & _ONE == 1
        first = (np.arange(len(keys)) == 0).astype(np.int64)  # the bucket's own numbers stand in one row
        ends = np.cumsum([len(x) for x in keys])
        return pa.table({
            "slice": table.column("slice"), "bucket": table.column("bucket"),
            "counts": pa.array([_packed(total[at[e - len(x):e]]) for x, e in zip(keys, ends)], pa.binary()),
            "n_words": first * int(word.sum()), "b": first * int(total[word, 0].sum()), "t": first * int(total[word, 1].sum())})

    sent = docs.groupBy("slice").applyInArrow(send, "slice bigint, bucket bigint, keys binary, counts binary")
    answers = saved(sent.groupBy("bucket").applyInArrow(answer, ANSWERS), "answers")
    known, *n = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "b", "t")]).first()

    def score(table, replies):
        row, second, key, at = _slice_keys(table)
        replies = replies.sort_by("bucket").column("counts").to_pylist()
        counts = np.concatenate([np.zeros((0, 4), np.int64), *[_unpacked(x, np.int64, 4) for x in replies]])
        if len(counts) != len(key):
            raise ValueError("the documents changed while they were read")
        p = (counts[at[:len(row)], :2] + 1) / (np.array(n, float) + known + 1)
        p[second] = (counts[at[len(row):], :2] + smoothing * p[second]) / (counts[at[second - 1], 2:] + smoothing)
        many = np.bincount(row, minlength=table.num_rows)
        loss = [np.bincount(row, weights=-np.log(p[:, x]), minlength=table.num_rows) / np.maximum(many, 1) for x in (1, 0)]
        none = many == 0
        return pa.table([table.column("doc_id"), pa.array(many.astype(np.int64))] + [pa.array(x, pa.float64(), mask=none) for x in (
            loss[0], loss[1], loss[0] - loss[1])], ["doc_id", "n_words", "target_loss", "background_loss", "score"])

    texts = docs.select("doc_id", "text", "slice").groupBy("slice")
    return texts.cogroup(answers.select("slice", "bucket", "counts").groupBy("slice")).applyInArrow(score, RESULT)
