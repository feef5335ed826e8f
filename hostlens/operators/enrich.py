"""Joins between record kinds (JOIN-1..8) and the detectors built on them.

All joins are equi-joins on ``collection_id`` plus an entity key, so they
shuffle on the key (or broadcast the small side when AQE measures it small at
runtime -- the size check is AQE's, with sort-merge beyond it).  The big
``bodyfile`` side is first cut down with a semi-join to the keys the small
side asks for, before anything is aggregated.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import first_token
from .detectors import ANOMALY_COLS, EVIDENCE_TYPE
from .numbering import materialized


def binary_paths(processes: DataFrame) -> DataFrame:
    """Processes with ``binary_path`` = first command token when it is an absolute path."""
    tok = first_token("command")
    return processes.withColumn("binary_path", F.when(tok.startswith("/"), tok))


def with_binary_info(processes: DataFrame, bodyfile: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """JOIN-1 / JOIN-2: ``binary_exists`` and ``binary_hash`` per process.

    ``binary_exists`` is NULL when the command has no absolute path; the hash is
    the bodyfile md5 (ignoring '0'), else the hash-list md5 of that path.
    """
    procs = binary_paths(processes)
    wanted = procs.where(F.col("binary_path").isNotNull()).select(
        "collection_id", F.col("binary_path").alias("name")).distinct()
    files = (bodyfile.join(wanted, ["collection_id", "name"], "left_semi")
             .groupBy("collection_id", "name")
             .agg(F.min(F.when(~F.col("md5").isin("0", ""), F.col("md5"))).alias("_md5"))
             .withColumn("_found", F.lit(True)))
    out = procs.join(files.withColumnRenamed("name", "binary_path"), ["collection_id", "binary_path"], "left")
    if hashes is not None:
        hl = (hashes.where(F.col("md5").isNotNull())
              .join(wanted.withColumnRenamed("name", "filepath"), ["collection_id", "filepath"], "left_semi")
              .groupBy("collection_id", "filepath").agg(F.min("md5").alias("_hmd5"))
              .withColumnRenamed("filepath", "binary_path"))
        out = out.join(hl, ["collection_id", "binary_path"], "left")
        hash_col = F.coalesce("_md5", "_hmd5")
    else:
        hash_col = F.col("_md5")
    return out.select(
        *processes.columns, "binary_path",
        F.when(F.col("binary_path").isNotNull(), F.coalesce(F.col("_found"), F.lit(False))).alias("binary_exists"),
        hash_col.alias("binary_hash"),
    )


def process_connections(processes: DataFrame, connections: DataFrame) -> DataFrame:
    """JOIN-3: each process with its connections (left join on collection, pid).

    Kept flat (one row per process x connection) rather than collected into a
    list, so a process with very many sockets never forms one huge row.
    """
    c = connections.select(
        "collection_id", F.col("pid").cast("bigint").alias("pid"),
        F.col("line_no").alias("conn_line_no"), "protocol", "local_address", "local_port",
        "remote_address", "remote_port", "state")
    return processes.join(c, ["collection_id", "pid"], "left")


def with_parent(processes: DataFrame) -> DataFrame:
    """JOIN-4: parent command by (collection, ppid); the first listing row of a
    pid (file, line order) stands for it when several files list it."""
    parents = processes.where(F.col("pid").isNotNull()).groupBy("collection_id", "pid").agg(
        F.min_by("command", F.struct("source_file", "line_no")).alias("parent_command"))
    parents = parents.withColumnRenamed("pid", "ppid")
    return processes.join(parents, ["collection_id", "ppid"], "left")


def process_ancestry(processes: DataFrame) -> DataFrame:
    """JOIN-4, all generations: (collection_id, pid, root_pid, depth, path) of every listed pid.

    ``path`` holds the pids from the root to the process, ``depth`` counts its steps.  The root is the first
    ancestor whose parent is not listed (null, 0, itself or unknown).  Processes on a cycle of parents, or below
    one, have no root: null root and depth, an empty path.  As in ``with_parent`` the first listing row of a pid
    stands for it.

    Pointer doubling: each round joins every process to what its pointer knows, so paths double and a chain of
    any depth takes log2(depth) joins; rounds are written, pairs that are done are not joined again."""
    first = processes.where("pid is not null").groupBy("collection_id", "pid").agg(
        F.min_by(F.struct("ppid"), F.struct("source_file", "line_no")).alias("p")).select("collection_id", "pid", F.col("p.ppid").alias("ppid"))
    listed = first.select("collection_id", F.col("pid").alias("ppid"), F.lit(True).alias("known"))
    pointers = first.join(listed, ["collection_id", "ppid"], "left")
    up = F.when(F.col("known") & (F.col("ppid") != F.col("pid")) & (F.col("ppid") != 0), F.col("ppid"))
    # ``path``: the process, last, after its ancestors below ``up``
    now = materialized(pointers.select("collection_id", F.col("pid").cast("bigint").alias("pid"), up.cast("bigint").alias("up"),
                                       F.array(F.col("pid").cast("bigint")).alias("path")), "ancestry")
    while True:
        done, open_ = now.where("up is null or up = -1"), now.where("up <> -1")
        if not open_.limit(1).count():
            break
        above = now.select("collection_id", F.col("pid").alias("up"), F.col("up").alias("next"), F.col("path").alias("more"))
        joined = open_.join(above, ["collection_id", "up"]).select(
            "collection_id", "pid", F.col("next").alias("up"), F.concat("more", "path").alias("path"))
        # a pid that comes again is on a cycle or below one: paths double until it does
        cyclic = (F.size(F.array_distinct("path")) < F.size("path")) | (F.coalesce(F.col("up"), F.lit(0)) == -1)
        joined = joined.select("collection_id", "pid", F.when(cyclic, F.lit(-1).cast("bigint")).otherwise(F.col("up")).alias("up"),
                               F.when(cyclic, F.array().cast("array<bigint>")).otherwise(F.col("path")).alias("path"))
        now = materialized(done.unionByName(joined), "ancestry")
    root = F.when(F.size("path") > 0, F.element_at("path", 1))
    return now.select("collection_id", "pid", root.alias("root_pid"), F.when(F.size("path") > 0, F.size("path") - 1).alias("depth"), "path")


def hash_mismatches(hashes: DataFrame, bodyfile: DataFrame) -> DataFrame:
    """JOIN-5: hash-list md5 differs from the bodyfile md5 of the same path ('0' skipped)."""
    h = hashes.where(F.col("md5").isNotNull()).select("collection_id", F.col("filepath").alias("name"),
                                                     F.col("md5").alias("listed_md5"))
    b = bodyfile.where(~F.col("md5").isin("0", "")).select("collection_id", "name", F.col("md5").alias("file_md5"))
    return h.join(b, ["collection_id", "name"]).where(F.col("listed_md5") != F.col("file_md5"))


def events_around(pivots: DataFrame, events: DataFrame, key: str, ts: str, seconds: int,
                  pivot_id: str, event_id: str) -> DataFrame:
    """JOIN-6: events within ``seconds`` of each pivot event with the same ``key``.

    Range join as an equi-join on (key, time bucket): the pivot side is copied
    into its own and both neighbouring buckets of width ``seconds``, so each
    task only sees one key's events of a short time slice, never a whole key.
    """
    width = seconds * 1_000_000
    p = pivots.select(F.col(key).alias("_k"), F.col(pivot_id).alias("pivot_id"),
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("_pt"))
    p = p.withColumn("_b", F.explode(F.array(*[F.floor(F.col("_pt") / width) + i for i in (-1, 0, 1)])))
    e = events.select(F.col(key).alias("_k"), F.col(event_id).alias("event_id"),
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("_et"))
    e = e.withColumn("_b", F.floor(F.col("_et") / width))
    j = p.join(e, ["_k", "_b"]).where(
        (F.col("_et") >= F.col("_pt") - width) & (F.col("_et") <= F.col("_pt") + width)
        & (F.col("event_id") != F.col("pivot_id")))
    return j.select(F.col("_k").alias(key), "pivot_id", "event_id", (F.col("_et") - F.col("_pt")).alias("delta_us"))


def failures_before(events: DataFrame, key: str, ts: str, is_failure, is_success, horizon_seconds: int = 86400,
                    min_failures: int = 3, id_col: str = "event_id") -> DataFrame:
    """DET-X5: success events preceded by >= ``min_failures`` failures of the same
    key within ``horizon_seconds`` (failure time in [t - horizon, t)).

    Time is cut into cells of a minute (or a shorter divisor of the horizon).  Failures are
    counted per (key, cell), pre-aggregated; the cells that lie wholly within the horizon
    are summed over these counts, and only the two cells at its ends are compared by time:
    the success's own, and the one a horizon earlier, whose failures are moved onto it.
    So no window holds more than the events of one key in two cells.
    """
    cell = math.gcd(horizon_seconds, 60)
    back, size, width = horizon_seconds // cell, cell * 1_000_000, horizon_seconds * 1_000_000
    ev = events.select(F.col(key).alias("_k"), F.col(id_col).alias("_id"),
                       F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"),
                       is_failure.alias("_fail"), is_success.alias("_ok"))
    ev = ev.where((F.col("_fail") | F.col("_ok")) & F.col("_t").isNotNull()).withColumn("_cell", F.floor(F.col("_t") / size))
    cells = ev.groupBy("_k", "_cell").agg(F.count(F.when(F.col("_fail"), 1)).alias("_c"), F.max("_ok").alias("_any"))
    inner = F.lit(0) if back < 2 else F.sum("_c").over(Window.partitionBy("_k").orderBy("_cell").rangeBetween(1 - back, -1))
    cells = cells.withColumn("_inner", F.coalesce(inner, F.lit(0))).where("_any").select("_k", "_cell", "_inner")
    moved = ev.where("_fail").select("_k", F.lit(None).cast(ev.schema["_id"].dataType).alias("_id"), (F.col("_t") + width).alias("_t"),
                                     F.lit(False).alias("_fail"), F.lit(False).alias("_ok"), (F.col("_cell") + back).alias("_cell"), F.lit(True).alias("_old"))
    near = ev.withColumn("_old", F.lit(False)).unionByName(moved).join(cells, ["_k", "_cell"])
    w = Window.partitionBy("_k", "_cell").orderBy("_t")
    last = F.count(F.when(F.col("_fail"), 1)).over(w.rangeBetween(Window.unboundedPreceding, -1))
    old = F.count(F.when(F.col("_old"), 1)).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    counted = near.withColumn("_n", last + old + F.col("_inner"))
    return counted.where(F.col("_ok") & (F.col("_n") >= min_failures)).select(
        F.col("_k").alias(key), F.col("_id").alias(id_col), F.col("_n").alias("failures"),
        F.timestamp_micros("_t").alias("ts"))


def ioc_matches(table: DataFrame, column: str, iocs: DataFrame, how: str = "left_semi") -> DataFrame:
    """JOIN-7: rows whose ``column`` equals an IOC value (semi join; AQE broadcasts a small IOC list)."""
    return table.join(iocs.select(F.col("value").alias(column)).distinct(), column, how)


def anomaly_scores(target: DataFrame, anomalies: DataFrame, key_col: str, anomaly_key: str) -> DataFrame:
    """JOIN-8: per entity the max anomaly score, the reasons and types (left join on the key)."""
    agg = anomalies.where(F.col(anomaly_key).isNotNull()).groupBy("collection_id", F.col(anomaly_key).alias(key_col)).agg(
        F.max("score").alias("anomaly_score"),
        F.array_sort(F.collect_set("title")).alias("anomaly_reasons"),
        F.array_sort(F.collect_set("anomaly_type")).alias("anomaly_flags"))
    return target.join(agg, ["collection_id", key_col], "left")


# ---------------------------------------------------------------------------
# Detectors that need a join
# ---------------------------------------------------------------------------
def _anomaly(df: DataFrame, *, anomaly_id, anomaly_type, severity, score, title, description, source_artifact,
             artifact_path=None, process_name=None, username=None, group_rank=4) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "collection_id", anomaly_id.alias("anomaly_id"), F.lit(anomaly_type).alias("anomaly_type"),
        F.lit(severity).alias("severity"), F.lit(float(score)).alias("score"), title.alias("title"),
        description.alias("description"), F.lit(source_artifact).alias("source_artifact"),
        (artifact_path if artifact_path is not None else none).alias("artifact_path"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        (username if username is not None else none).alias("username"),
        (process_name if process_name is not None else none).alias("process_name"),
        none.alias("mitre_technique"), F.array().cast(EVIDENCE_TYPE).alias("evidence"),
        F.array().cast("array<string>").alias("investigation_steps"),
        F.struct(F.lit(group_rank).alias("g"), F.lit(0).alias("r0"), F.col("source_file").alias("f"),
                 F.col("line_no").alias("n"), F.lit(0).alias("r")).alias("ord"),
    ).select(*ANOMALY_COLS)


def detect_deleted_binaries(processes_with_binary: DataFrame) -> DataFrame:
    """DET-X1: process whose absolute binary path is missing from the file listing."""
    df = processes_with_binary.where(F.col("binary_exists") == F.lit(False))
    return _anomaly(df, anomaly_id=F.concat(F.lit("proc_"), F.col("pid").cast("string"), F.lit("_deleted_binary")),
                    anomaly_type="deleted_binary", severity="high", score=0.85,
                    title=F.concat(F.lit("Binary not on disk: "), F.col("binary_path")),
                    description=F.concat(F.lit("Process PID "), F.col("pid").cast("string"),
                                         F.lit(" runs a binary that is absent from the file listing")),
                    source_artifact="process_list", artifact_path=F.col("binary_path"),
                    username=F.col("user"))


def detect_hidden_processes(connections: DataFrame, processes: DataFrame) -> DataFrame:
    """DET-X3: connection owned by a pid that no process listing of the collection shows."""
    known = processes.select("collection_id", F.col("pid").cast("bigint").alias("_pid")).distinct()
    c = connections.where(F.col("pid").isNotNull()).withColumn("_pid", F.col("pid").cast("bigint"))
    orphan = c.join(known, ["collection_id", "_pid"], "left_anti")
    return _anomaly(orphan, anomaly_id=F.concat(F.lit("net_hidden_"), F.col("pid").cast("string")),
                    anomaly_type="rootkit_indicator", severity="high", score=0.75,
                    title=F.concat(F.lit("Connection owned by unlisted PID "), F.col("pid").cast("string")),
                    description=F.concat(F.lit("PID "), F.col("pid").cast("string"),
                                         F.lit(" holds a socket but is missing from the process listing")),
                    source_artifact="network_connections", process_name=F.col("program"))


# cron rule (declared, not computed, by the reference): the process-path and
# encoded-command markers of the process detectors, applied to cron log lines
SUSPICIOUS_CRON_MARKERS = rules.PROCESS_TEMP_DIRS + rules.ENCODED_COMMAND_MARKERS


def detect_suspicious_cron(logs: DataFrame) -> DataFrame:
    """DET-X2: cron log lines whose command uses temp paths or shell/encoding tricks."""
    from ..functions.columns import contains_any
    msg = F.lower(F.coalesce(F.col("message"), F.lit("")))
    df = logs.where((F.lower(F.coalesce(F.col("process"), F.lit(""))).contains("cron"))
                    & contains_any(msg, SUSPICIOUS_CRON_MARKERS))
    return _anomaly(df, anomaly_id=F.concat(F.lit("log_"), F.col("line_no").cast("string"), F.lit("_suspicious_cron")),
                    anomaly_type="suspicious_cron", severity="high", score=0.8,
                    title=F.lit("Suspicious scheduled command"), description=F.col("message"),
                    source_artifact="logs", artifact_path=F.col("source_file"))


def detect_privilege_changes(logs: DataFrame) -> DataFrame:
    """DET-X4: sudo / su log lines that switch to root."""
    msg = F.coalesce(F.col("message"), F.lit(""))
    proc = F.lower(F.coalesce(F.col("process"), F.lit("")))
    df = logs.where(((proc == "sudo") & msg.contains("USER=root")) | ((proc == "su") & F.lower(msg).contains("root")))
    return _anomaly(df, anomaly_id=F.concat(F.lit("log_"), F.col("line_no").cast("string"), F.lit("_priv_change")),
                    anomaly_type="privilege_escalation", severity="medium", score=0.65,
                    title=F.lit("Switch to root"), description=F.col("message"),
                    source_artifact="logs", artifact_path=F.col("source_file"))


def detect_login_bursts(logs: DataFrame, horizon_seconds: int = 86400, min_failures: int = 3) -> DataFrame:
    """DET-X5 on parsed logs: a login accepted from an address after at least ``min_failures`` failed ones from
    it within ``horizon_seconds``."""
    message = F.coalesce("message", F.lit(""))
    address = F.regexp_extract(message, r"from ([0-9A-Fa-f.:]+)", 1)
    ev = logs.where(F.col("timestamp").isNotNull() & (address != "")).select(
        F.struct("collection_id", address.alias("address")).alias("who"), F.struct("source_file", "line_no").alias("place"),
        "timestamp", message.contains("Failed password").alias("_f"), message.contains("Accepted").alias("_s"))
    found = failures_before(ev, "who", "timestamp", F.col("_f"), F.col("_s"), horizon_seconds, min_failures, "place")
    rows = found.select("who.collection_id", "who.address", "place.source_file", "place.line_no", "failures")
    n = F.col("failures").cast("string")
    return _anomaly(rows, anomaly_id=F.concat_ws("_", F.lit("log"), F.col("line_no").cast("string"), F.lit("login_burst")),
                    anomaly_type="unauthorized_access", severity="high", score=0.85, title=F.lit("Login after repeated failures"),
                    description=F.concat(n, F.lit(" failed logins from "), F.col("address"), F.lit(" before this one")),
                    source_artifact="logs", artifact_path=F.col("source_file"))
