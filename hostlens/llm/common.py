"""Helpers shared by the operators: shared folders, worker-side caches, Arrow glue, byte vectors."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/hostlens-llm/{name}-{uuid.uuid4().hex}"


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Shuffle files are released as each write ends unless the session says otherwise: what is read again is written."""
    if df.sparkSession.conf.get(RELEASE, None) is None:
        df.sparkSession.conf.set(RELEASE, "true")
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PARTITION_ROWS = 4000


def gathered(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` in at most a partition for each ``PARTITION_ROWS`` of ``rows``, the documents it is about, or one for each core
    if these are more (None: as it is).

    Partitions are put one after the other, so none gets larger.  Each file that is written starts processes on a local
    file system (Hadoop's ``chmod``), which count as large as the executor until they run."""
    return df if rows is None else df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS)))


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process (tasks of one worker share it)."""
    module = sys.modules.setdefault("_hostlens_llm_worker_cache", types.ModuleType("_hostlens_llm_worker_cache"))
    return module.__dict__.setdefault(name, {})


def with_field(schema: T.StructType, name: str, dtype: T.DataType) -> T.StructType:
    """``schema`` with one output column; an input column of that name is replaced."""
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, dtype)])


def set_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with ``name`` appended, in place of any column of that name."""
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in names] + [values], names + [name])


def binary_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (int64, one more than rows) of a string/binary array; null rows are empty."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=width, count=len(col) + col.offset + 1)[col.offset:].astype(np.int64) if off else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, most: int):
    """(first, end) row ranges of about ``most`` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(end, n)
        first = min(end, n)


def slices(batches, column: str, most: int = 4 << 20):
    """Record batches cut into pieces whose ``column`` holds about ``most`` bytes each."""
    for batch in batches:
        col = batch.column(batch.schema.names.index(column))
        if pa.types.is_list(col.type):
            offsets = col.offsets.to_numpy().astype(np.int64) * 4
        else:
            offsets = binary_view(col)[1]
        for first, end in row_groups(offsets, most):
            yield batch.slice(first, end - first)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64 vectors."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def sliding_min(x: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """Minimum (or, with ``np.maximum``, maximum) of every ``width`` consecutive entries, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = least(out[:-step], out[step:])
        have += step
    return out


SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 14


def _powers() -> np.ndarray:
    cache = worker_cache("powers")
    if "p" not in cache:
        steps = np.full(_SPAN, np.uint64(_BASE))
        steps[0] = 1
        cache["p"] = np.multiply.accumulate(steps)
    return cache["p"]


def span_sums(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two polynomial sums of the bytes of each span; spans begin at ``first`` and cover ``raw``."""
    power = _powers()
    within = np.arange(len(raw), dtype=np.int64) - np.repeat(first, np.diff(np.append(first, len(raw))))
    factor = power[within & (_SPAN - 1)]
    far = within >= _SPAN  # only in spans of more than 16 KB
    if far.any():
        at = np.flatnonzero(far)
        factor[at] *= mix64((within[at] >> 14).astype(np.uint64)) | np.uint64(1)
    value = (raw.astype(np.uint64) + np.uint64(1)) * factor
    other = (value ^ (value >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return np.add.reduceat(value, first), np.add.reduceat(other, first)


def hashed_words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of concatenated rows: first byte, end, row, 64-bit hash."""
    space = SPACES[raw]
    edge = np.ones(len(raw) + 1, bool)  # a word may start here: after white space or at a row's start
    edge[1:] = space
    edge[starts] = True
    first = np.flatnonzero(edge[:-1] & ~space)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    stop = np.append(space, True)
    stop[starts[1:]] = True
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, first, side="right")]
    row = np.searchsorted(starts, first, side="right") - 1
    power = _powers()
    length = end - first
    within = np.arange(len(raw), dtype=np.int64) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(raw)]])))
    value = (raw.astype(np.uint64) + np.uint64(1)) * power[within & (_SPAN - 1)]
    far = within >= _SPAN  # only in words of more than 16 KB
    if far.any():
        at = np.flatnonzero(far & ~space)
        value[at] *= mix64((within[at] >> 14).astype(np.uint64)) | np.uint64(1)
    value[space] = 0
    total = np.add.reduceat(value, first)
    return first, end, row, mix64(total ^ (length.astype(np.uint64) << np.uint64(48)))


def bit_words(hashes: DataFrame, bits: int) -> np.ndarray:
    """A table of ``bits`` bits as signed 64-bit words, two bits set for each 64-bit hash in column ``h``."""
    both = hashes.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("b"))
    words = both.groupBy((F.shiftright("b", 6)).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("b").bitwiseAND(F.lit(63))).cast("int"))).alias("v"))
    found = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out


def bit_table(hashes: DataFrame, bits: int):
    """The table of ``bit_words`` as a literal column, for use within lambdas (every text of the plan spells it out)."""
    return F.split(F.lit(",".join(map(str, bit_words(hashes, bits).tolist()))), ",").cast("array<bigint>")


def listed(df: DataFrame, h, hashes: DataFrame, count: int, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose hash ``h`` is one of the ``count`` hashes in column ``h`` of ``hashes``, and few others
    (``left_anti``: the rest).

    The bit table is a broadcast row of 2 MB at most.  As a literal it would stand in each text of the plan, which
    Spark writes again for every stage and keeps in the driver."""
    bits = table_bits(count)
    row = pa.table({"listed_bits": pa.array([bit_words(hashes, bits)], pa.list_(pa.int64()))})
    table = df.sparkSession.createDataFrame(row, "listed_bits array<bigint>")
    return df.join(F.broadcast(table), may_contain(F.col("listed_bits"), h, bits), how)


def in_bits(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``may_contain`` on vectors: words as uint64, h as uint64."""
    mask = np.uint64(len(words) * 64 - 1)
    out = np.ones(len(h), bool)
    for probe in (h >> np.uint64(32), h):
        b = probe & mask
        out &= (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return out


def _probes(h, bits: int):
    return [F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)).cast("int"), h.bitwiseAND(F.lit(bits - 1)).cast("int")]


def may_contain(table, h, bits: int):
    """Whether ``h`` may be one of the hashes of ``bit_table``."""
    one = [F.call_function("bit_get", F.get(table, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1 for b in _probes(h, bits)]
    return one[0] & one[1]


def table_bits(count: int, most: int = 1 << 24) -> int:
    """Bits for a table of ``count`` hashes: 32 to 64 each, 2 MB at most."""
    return min(most, 1 << max(16, (32 * count).bit_length()))
