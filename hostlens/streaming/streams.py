"""Structured Streaming forms of the batch operators (STR-1..5).

The parsers and stateless detectors are Column expressions, so they apply to
streaming frames unchanged.  Stateful pieces use event-time watermarks, so
state is dropped once the watermark passes and late rows beyond it are
discarded (documented difference from the batch form).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import text_parsers as tp


def log_line_stream(spark: SparkSession, directory: str, glob: str = "*", collection_id: str | None = None) -> DataFrame:
    """STR-1 input: text files arriving in ``directory`` as a lines frame.

    Each micro-batch holds whole new files; ``line_no`` is the position of the
    line in its file (``posexplode`` of the file content), so parsing keeps
    file order like the batch reader.
    """
    raw = (spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", "true").load(directory))
    path = F.col("_metadata.file_path")
    cid = F.lit(collection_id) if collection_id else F.regexp_extract(path, r"/([^/]+)/[^/]*$", 1)
    return raw.select(cid.alias("collection_id"), path.alias("source_file"),
                      F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint"))


def parsed_logs(lines: DataFrame, reference_year=None) -> DataFrame:
    """STR-1: typed log rows from a (streaming) lines frame."""
    return tp.parse_logs(lines, reference_year=reference_year)


def hourly_counts(events: DataFrame, ts_col: str = "timestamp", keys: list[str] | None = None,
                  watermark: str | None = "2 hours") -> DataFrame:
    """STR-2: tumbling 1-hour event counts per key.

    Rows later than the watermark are dropped, which bounds the state of an endless stream.  ``None`` (for a
    replay of files in any order) keeps every hour's count."""
    keys = keys or ["collection_id"]
    timed = events.where(F.col(ts_col).isNotNull())
    timed = timed if watermark is None else timed.withWatermark(ts_col, watermark)
    return (timed.groupBy(*keys, F.window(ts_col, "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("event_count"))
            .select(*keys, F.col("w.start").alias("window_start"), "event_count"))


def dedup_anomalies(anomalies: DataFrame, ts_col: str = "detected_at", horizon: str = "1 hour") -> DataFrame:
    """STR-4: drop repeats of (collection, anomaly id) seen within the watermark horizon.

    On a batch frame (all data known) this is a plain ``dropDuplicates``.
    """
    keys = ["collection_id", "anomaly_id"]
    if not anomalies.isStreaming:
        return anomalies.dropDuplicates(keys)
    return anomalies.withWatermark(ts_col, horizon).dropDuplicatesWithinWatermark(keys)


def failure_bursts(events: DataFrame, key: str, ts_col: str, is_failure, min_failures: int = 3,
                   window: str = "10 minutes", slide: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """STR-5: sliding-window failure counts per key, keeping windows with >= ``min_failures``."""
    return (events.where(is_failure).withWatermark(ts_col, watermark)
            .groupBy(F.col(key), F.window(ts_col, window, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("failures"))
            .where(F.col("failures") >= min_failures)
            .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failures"))


def run_available_now(df: DataFrame, out_dir: str | None = None, name: str = "stream") -> str:
    """Run a streaming aggregate to completion over the data available now.

    Update-mode micro-batches are appended with their batch id to a Parquet
    folder under the session's checkpoint directory (shared storage on a
    cluster); ``latest_rows`` folds them into the final table.  Given the same
    ``out_dir`` again, the query resumes from its checkpoint next to it and
    only processes new input.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if out_dir is None:
        run = uuid.uuid4().hex[:12]
        out_dir, ckpt = f"{base}/{name}-{run}/out", f"{base}/{name}-{run}/checkpoint"
    else:
        ckpt = out_dir.rstrip("/") + ".checkpoint"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(out_dir)

    q = (df.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    # schema-only append so the folder exists even when no batch carried rows
    empty = spark.createDataFrame([], df.schema).withColumn("_batch_id", F.lit(None).cast("bigint"))
    empty.write.mode("append").parquet(out_dir)
    return out_dir


def latest_rows(spark: SparkSession, out_dir: str, keys: list[str]) -> DataFrame:
    """Final value per key from update-mode batches (the latest batch wins)."""
    df = spark.read.parquet(out_dir)
    vals = [c for c in df.columns if c not in keys and c != "_batch_id"]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_batch_id").alias("_v"))
    return agg.select(*keys, *[F.col("_v." + c).alias(c) for c in vals])
