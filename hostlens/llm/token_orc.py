"""Token ids in ORC files: run-length-encoded stripes, row indexes, Bloom filters on document ids.

``write_tokens`` tokenises whole texts, appends an end id to each document and
writes one row per document (``doc_id, n_tokens, file_no, file_start, ids``) in
ascending ``doc_id`` order: the rows are range-partitioned and sorted, each
partition makes one file, and ``file_start`` counts the ids before the row in
its file.  ORC stores the integer columns as run-length-encoded stripes with a
row index every ``row_index_stride`` rows and Bloom filters on ``doc_id``; reads
run stripe-parallel, and predicates on ``doc_id`` skip stripes and row groups by
that metadata (``lookup``).  ``read_tokens`` gives each document its global
``start``: the ids of all earlier files (one small row per file) plus
``file_start``.

Defined results: null text is the empty text (only the end id); rows of equal
``doc_id`` follow each other in order of their text's hash; a null ``doc_id``
sorts first; only the id and text columns are read, so further columns, also
ones named like an output, do not matter; an empty table gives no files' rows.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunked import ChunkedEncoder
from .common import binary_view, slices, worker_cache

SCHEMA = "doc_id bigint, n_tokens bigint, file_no int, file_start bigint, ids array<int>"


MOST_WORDS = 400_000
# a space, letters, marks; perhaps a line end and the same again.  Each part is a pre-token of its own: letters up
# to U+024F are letters in every library's tables, an apostrophe might start a contraction and is left out
LETTERS, MARK = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+", r"!-&(-/:-@\[-`{-~"
MARKS = f"[{MARK}]*"
PLAIN = re.compile(f" ({LETTERS})({MARKS})(?:\n({LETTERS})({MARKS}))?").fullmatch


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in own)
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(others)}}


def chunk_encoder(vocabulary: str, path_key: str, special_as_text: bool = False, most: int = 1_200_000,
                  most_words: int = MOST_WORDS) -> ChunkedEncoder:
    """The library's ids of whole texts, added tokens and all; ``special_as_text`` takes their strings for ordinary text."""
    cache, key = worker_cache("token_orc"), (path_key, special_as_text, most, most_words)
    if key not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.encode_special_tokens = special_as_text

        if hasattr(tokenizer.model, "_resize_cache"):
            tokenizer.model._resize_cache(0)  # chunks come once each: the library's own cache only costs time
        spec = json.loads(vocabulary)
        before = spec.get("pre_tokenizer") or {}
        # the pre-tokens of byte-level words are known
        by_letters = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                      and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"))
        # added tokens that could stand in a plain chunk: there no mark comes right before a letter
        added = [] if special_as_text else [t["content"] for t in spec.get("added_tokens", [])
                                            if not re.search(f"[{MARK}]{LETTERS}", t["content"])]
        letter = byte_letters()
        words: dict[str, bytes] = {}
        marks: dict[str, bytes] = {}

        def whole(chunks: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for k in range(0, len(chunks), 5000):
                found = tokenizer.encode_batch_fast(chunks[k:k + 5000], add_special_tokens=False)
                out += [array("i", e.ids).tobytes() for e in found]
            return out

        def word(text: str) -> bytes:
            """Ids of letters, perhaps after a space, straight from the library's merge model."""
            found = words.get(text)
            if found is None:
                mapped = text.encode().decode("latin-1").translate(letter)
                found = words[text] = array("i", [t.id for t in tokenizer.model.tokenize(mapped)]).tobytes()
            return found

        def mark(text: str) -> bytes:
            found = marks.get(text)
            if found is None:
                if len(marks) > most_words:
                    marks.clear()
                found = marks[text] = whole([text])[0]
            return found

        def learn(chunks: list[str]) -> list[bytes]:
            if len(words) > most_words:
                words.clear()
            out: list[bytes | None] = []
            for c in chunks:
                found = None
                if by_letters and (m := PLAIN(c)) and not (added and any(a in c for a in added)):
                    core, after, core2, after2 = m.groups()
                    found = word(" " + core)
                    if after:
                        found += mark(after)
                    if core2:
                        found += mark("\n") + word(core2) + (mark(after2) if after2 else b"")
                out.append(found)
            rest = [i for i, x in enumerate(out) if x is None]
            for i, x in zip(rest, whole([chunks[i] for i in rest])):
                out[i] = x
            return out

        cache.clear()
        cache[key] = ChunkedEncoder(learn, most=most)
    return cache[key]


def write_tokens(df: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", files: int | None = None, row_index_stride: int = 1000,
                 stripe_bytes: int = 16 << 20) -> None:
    """Write the ids of every text under ``folder`` as ORC (``SCHEMA``), one file per range of ids."""
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a vocabulary file: fixed size
    key = f"{tokenizer_path}#{os.path.getsize(tokenizer_path)}"
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
            .select("doc_id", "text", F.spark_partition_id().alias("file_no")))

    def run(batches):
        encoder, start = chunk_encoder(vocabulary.value, key), 0
        for part in slices(batches, "text", 3 << 20):
            flat, offsets = encoder.encode_rows(*binary_view(part.column("text")))
            flat = np.insert(flat, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))  # with the end ids
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), part.column("file_no"), pa.array(start + offsets[:-1]),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))],
                ["doc_id", "n_tokens", "file_no", "file_start", "ids"])
            start += int(offsets[-1])

    (rows.mapInArrow(run, SCHEMA).write
     .option("compression", "snappy").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.row.index.stride", row_index_stride).option("orc.stripe.size", stripe_bytes)
     .orc(folder))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: ``start`` counts the ids of all documents before."""
    rows = read_files(spark, folder)
    # one row per file; the offsets of files are sums over that small table
    sizes = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    before = _file_bases(sizes)
    return (rows.join(F.broadcast(before), "file_no")  # as many rows as files
            .select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids"))


def _file_bases(sizes: DataFrame) -> DataFrame:
    spark, base, out = sizes.sparkSession, 0, []
    for file_no, total in sizes.orderBy("file_no").collect():  # as many rows as files
        out.append((file_no, base))
        base += total
    return spark.createDataFrame(out, "file_no int, base bigint")


def with_ids_crc32(df: DataFrame, ids_col: str = "ids", out_col: str = "ids_crc32") -> DataFrame:
    """``ids_col`` replaced by the unsigned crc32 of its ids as little-endian 32-bit integers."""
    import zlib

    keep = [f for f in df.schema.names if f != ids_col]

    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.names.index(ids_col))
            offsets, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            raw = memoryview(values.view(np.uint8))
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(c)) for c in keep]
                                             + [pa.array(crc, pa.int64())], [*keep, out_col])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{fields}, {out_col} bigint")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Rows of the given documents; min/max, row indexes and Bloom filters skip the other stripes."""
    return read_files(spark, folder).where(F.col("doc_id").isin(doc_ids))
