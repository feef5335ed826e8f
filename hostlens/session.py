"""Spark session helpers.

The engine assumes a UTC session clock (epoch columns are turned into
timestamps with ``timestamp_seconds``) and AQE switched on so that join
strategies and shuffle partition counts are picked from runtime sizes.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the engine relies on.  They are applied only when the session does
# not set them already, so a cluster configuration always wins.
ENGINE_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "hostlens", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in ENGINE_DEFAULTS.items():
        builder = builder.config(k, v)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_engine_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


# Arrow batches for the Python helpers (text split, YAML decode): rows of whole
# documents can be large, so batches are bounded by rows and bytes unless the
# cluster configuration says otherwise.
ARROW_BATCH_DEFAULTS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


# Parsers and text builders make long expressions.  Fused into one method they pass the 8000 bytes of bytecode
# beyond which the JVM never compiles a method, and run interpreted; below this limit Spark splits them.
CODEGEN_DEFAULTS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def ensure_engine_conf(spark: SparkSession) -> None:
    """Pin the session clock to UTC; bound Arrow batches and let later map keys win
    (record merges like Timesketch rows) when unset; keep every other setting."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.mapKeyDedupPolicy", None) is None:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    for k, v in {**ARROW_BATCH_DEFAULTS, **CODEGEN_DEFAULTS}.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is; unset,
    it is an error, since a folder of one machine would lose what others write.
    Only a local master (tests, the bench) gets a scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set; name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="hostlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
