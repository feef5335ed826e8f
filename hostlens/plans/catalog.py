"""Registered queries over the driver tables.

Each query reads whole tables at ``sf_dir``, derives artifact text from them
(``plans.derived``), runs the engine's operators and returns a DataFrame whose
columns match the DuckDB statement of the same name in ``plans.oracle_sql``.
Timestamps leave as ``yyyy-MM-dd HH:mm:ss.SSSSSS`` text so both engines print
them identically.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import columns as cols
from ..functions import text as txt
from ..operators import chunks as ch
from ..operators import detectors as det
from ..operators import enrich as en
from ..operators import files
from ..operators import ioc
from ..operators import prompts as pr
from ..operators import pruned_search as ps
from ..operators import retrieval as ret
from ..operators import timeline as tl
from ..session import ensure_engine_conf
from ..sources import archive as arc
from ..sources import text_parsers as tp
from . import derived as d

TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
REFERENCE_YEAR = 2024  # year of the derived collections (syslog lines carry no year)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_engine_conf(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


def ts_text(c) -> F.Column:
    return F.date_format(c, TS_TEXT)


# ---------------------------------------------------------------------------
# Shared derived tables
# ---------------------------------------------------------------------------
def event_logs(spark, sf_dir) -> DataFrame:
    return tp.parse_logs(d.event_log_lines(d.read_table(spark, sf_dir, "events")), reference_year=REFERENCE_YEAR)


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------
@register("log_parse")
def log_parse(spark, sf_dir):
    """SRC-18, SCA-7, SCA-8: syslog / ISO / plain log lines -> typed rows."""
    return event_logs(spark, sf_dir).select(
        "collection_id", "source_file", "line_no", "log_type", ts_text("timestamp").alias("ts_text"),
        "hostname", "process", "pid", "message")


@register("timeline_hourly")
def timeline_hourly(spark, sf_dir):
    """TL-3 + AGG-3 / CHK-6: hourly timeline text blocks with counts and tags."""
    hours = tl.hourly_buckets(tl.log_events(event_logs(spark, sf_dir)))
    return hours.select("collection_id", "hour", "segment", "event_count", ts_text("first_event").alias("first_event"),
                        "content", F.array_join("tags", ",").alias("tags"))


def bodyfile(spark, sf_dir) -> DataFrame:
    return tp.parse_bodyfile(d.bodyfile_lines(d.read_table(spark, sf_dir, "lineitem")))


def processes(spark, sf_dir) -> DataFrame:
    """Route each ps file to its parser by file name (SRC-8), then union the results."""
    lines = d.process_lines(d.read_table(spark, sf_dir, "events"))
    kind = arc.live_kind("source_file")
    return (tp.parse_ps_aux(lines.where(kind == "ps_aux"))
            .unionByName(tp.parse_ps_ef(lines.where(kind == "ps_ef")))
            .unionByName(tp.parse_ps_generic(lines.where(kind == "ps_generic"))))


def connections(spark, sf_dir) -> DataFrame:
    return tp.parse_netstat(d.netstat_lines(d.read_table(spark, sf_dir, "lineitem")))


def users(spark, sf_dir) -> DataFrame:
    return tp.parse_passwd(d.passwd_lines(d.read_table(spark, sf_dir, "customer")))


BODY_OUT = ["collection_id", "line_no", "md5", "name", "inode", "mode", "uid", "gid", "size",
            "atime", "mtime", "ctime", "crtime"]


@register("bodyfile_parse")
def bodyfile_parse(spark, sf_dir):
    """SRC-7, FIL-1..3, SCA-1..3: file-metadata lines -> typed rows with flags."""
    bf = tp.with_bodyfile_flags(bodyfile(spark, sf_dir))
    return bf.select(*BODY_OUT, "is_executable", "is_setuid", "is_directory",
                     cols.base_name("name").alias("filename"), cols.parent_dir("name").alias("parent_dir"),
                     cols.iso_text("mtime_ts").alias("mtime_iso"))


BODY_GLOB = "/home/u*/.cache/f1[!0-4]*_[1-3]"


@register("bodyfile_glob")
def bodyfile_glob(spark, sf_dir):
    """FIL-5: glob on the path."""
    return files.filter_by_path(bodyfile(spark, sf_dir), BODY_GLOB).select("collection_id", "line_no", "name")


TIME_RANGE = ("1995-01-01 00:00:00", "1996-12-31 23:59:59")


@register("bodyfile_time_range")
def bodyfile_time_range(spark, sf_dir):
    """FIL-6: inclusive mtime range."""
    bf = files.filter_by_timerange(bodyfile(spark, sf_dir), *TIME_RANGE, time_type="mtime")
    return bf.select("collection_id", "line_no", "name", "mtime")


@register("bodyfile_selections")
def bodyfile_selections(spark, sf_dir):
    """FIL-4 / FIL-9 / AGG-1: per collection counts of the bodyfile selections (one scan)."""
    bf = bodyfile(spark, sf_dir)
    mode, name = F.col("mode"), F.col("name")
    sel = {
        "executables": files.is_executable() & ~files.is_directory(), "setuid": files.is_setuid(),
        "directories": files.is_directory(), "with_hash": ~F.col("md5").isin("0", ""),
        "suspicious_locations": cols.contains_any(name, rules.SUSPICIOUS_LOCATION_MARKERS),
    }
    agg = bf.groupBy("collection_id").agg(*[F.count_if(c).alias(k) for k, c in sel.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("selection"), F.col(k).alias("n")) for k in sel]))
    return agg.select("collection_id", pairs.alias("p")).select(
        "collection_id", F.col("p.selection").alias("selection"), F.col("p.n").alias("n")).where(F.col("n") > 0)


PROC_OUT = ["collection_id", "source_file", "line_no", "pid", "ppid", "user", "cpu", "mem", "vsz", "rss",
            "tty", "stat", "start", "time", "command"]


@register("process_parse")
def process_parse(spark, sf_dir):
    """SRC-8..11, SCA-4: ps aux / ps -ef / generic listings -> processes."""
    return processes(spark, sf_dir).select(*PROC_OUT, cols.exe_name("command").alias("executable_name"))


@register("netstat_parse")
def netstat_parse(spark, sf_dir):
    """SRC-13, SCA-5: netstat lines -> connections."""
    return connections(spark, sf_dir).select("collection_id", "source_file", "line_no", *tp.CONNECTION_COLS)


@register("passwd_parse")
def passwd_parse(spark, sf_dir):
    """SRC-16: account lines -> users."""
    return users(spark, sf_dir).select("collection_id", "source_file", "line_no", "username", "uid", "gid",
                                       "gecos", "home", "shell", "is_system_user", "has_valid_shell")


def hashes(spark, sf_dir) -> DataFrame:
    return tp.parse_hashes(d.hash_lines(d.read_table(spark, sf_dir, "documents")))


@register("hash_classify")
def hash_classify(spark, sf_dir):
    """SRC-17, SCA-15: hash list lines -> (path, md5 | sha1 | sha256)."""
    return hashes(spark, sf_dir).select("collection_id", "source_file", "line_no", "filepath", "md5", "sha1", "sha256")


@register("artifact_categorise")
def artifact_categorise(spark, sf_dir):
    """SRC-4, SRC-8: member path -> category and live-response parser kind."""
    paths = d.member_paths(d.read_table(spark, sf_dir, "pages"))
    cat = arc.categorize_path("relative_path")
    return paths.select("collection_id", "page_id", "relative_path", cat.alias("category"),
                        F.when(cat == "live_response", arc.live_kind("relative_path")).alias("live_kind"))


def timeline(spark, sf_dir, sort: bool = True) -> DataFrame:
    merged = tl.merge_timeline(tl.bodyfile_events(bodyfile(spark, sf_dir)), tl.log_events(event_logs(spark, sf_dir)),
                               sort=False)
    if not sort:
        return merged
    return merged.orderBy("collection_id", *tl.ORDER_COLS)


@register("timeline_union")
def timeline_union(spark, sf_dir):
    """TL-1..4: file-modified / file-created / log events merged and sorted."""
    t = timeline(spark, sf_dir)
    x = F.col("extra_data")
    return t.select("collection_id", ts_text("timestamp").alias("ts"), "timestamp_desc", "source", "source_type",
                    "message", "artifact_path", "hostname", "pid",
                    F.try_element_at(x, F.lit("md5")).alias("extra_md5"),
                    F.try_element_at(x, F.lit("size")).alias("extra_size"),
                    F.try_element_at(x, F.lit("mode")).alias("extra_mode"))


@register("timesketch_rows")
def timesketch_rows(spark, sf_dir):
    """SNK-1: Timesketch record (extra_data merged over the fixed keys), as columns."""
    r = tl.timesketch_rows(timeline(spark, sf_dir, sort=False))
    keys = ["datetime", "timestamp_desc", "message", "source_short", "source_long", "data_type", "md5", "size", "mode"]
    return r.select("collection_id", *[F.try_element_at("record", F.lit(k)).alias(k) for k in keys])


def anomaly_out(a: DataFrame) -> DataFrame:
    """Flat anomaly columns for the checks (evidence: count and first raw text)."""
    return a.select(
        "collection_id", "anomaly_id", "anomaly_type", "severity", "score", "title", "description",
        "source_artifact", "artifact_path", ts_text("timestamp").alias("ts"), "username", "process_name",
        "mitre_technique", F.size("evidence").alias("evidence_count"),
        F.get("evidence", 0)["raw_data"].alias("evidence_raw"),
        F.array_join("investigation_steps", " | ").alias("steps"))


@register("detect_process")
def detect_process(spark, sf_dir):
    """DET-P1..P3."""
    return anomaly_out(det.detect_processes(processes(spark, sf_dir)))


@register("detect_network")
def detect_network(spark, sf_dir):
    """DET-N1, N2."""
    return anomaly_out(det.detect_network(connections(spark, sf_dir)))


@register("detect_files")
def detect_files(spark, sf_dir):
    """DET-F1..F3."""
    return anomaly_out(det.detect_files(bodyfile(spark, sf_dir)))


@register("detect_users")
def detect_users(spark, sf_dir):
    """DET-U1, U2."""
    return anomaly_out(det.detect_users(users(spark, sf_dir)))


def all_anomalies(spark, sf_dir, threshold="low") -> DataFrame:
    return det.detect_all(processes(spark, sf_dir), connections(spark, sf_dir), bodyfile(spark, sf_dir),
                          users(spark, sf_dir), threshold=threshold)


@register("anomalies_ranked")
def anomalies_ranked(spark, sf_dir):
    """DET-ALL, SET-1, FIL-12 (threshold 'high'), SRT-1."""
    ranked = det.rank_anomalies(all_anomalies(spark, sf_dir, threshold="high"))
    return anomaly_out(ranked).withColumn("severity_rank", cols.severity_rank("severity"))


@register("anomaly_counts")
def anomaly_counts(spark, sf_dir):
    """AGG-2: zero-filled severity histogram with total, per collection."""
    return det.severity_counts(all_anomalies(spark, sf_dir))


@register("allowlist_anti")
def allowlist_anti(spark, sf_dir):
    """SET-4: setuid files not in the system allow-list (anti join, 6-row broadcast side)."""
    allow = spark.createDataFrame([(p,) for p in rules.SYSTEM_SETUID_ALLOWLIST], "name string")
    s = files.setuid_files(bodyfile(spark, sf_dir))
    return s.join(F.broadcast(allow), "name", "left_anti").select("collection_id", "line_no", "name", "mode")


@register("hidden_process_anti")
def hidden_process_anti(spark, sf_dir):
    """DET-X3: sockets whose pid is in no process listing of the collection."""
    a = en.detect_hidden_processes(connections(spark, sf_dir), processes(spark, sf_dir))
    return a.select("collection_id", "anomaly_id", "anomaly_type", "title", "process_name",
                    F.col("ord")["n"].alias("line_no"))


@register("process_binary_join")
def process_binary_join(spark, sf_dir):
    """JOIN-1 / JOIN-2 / DET-X1: binary path, existence and md5 per process."""
    p = en.with_binary_info(processes(spark, sf_dir), bodyfile(spark, sf_dir))
    return p.select("collection_id", "source_file", "line_no", "pid", "binary_path", "binary_exists", "binary_hash")


@register("deleted_binaries")
def deleted_binaries(spark, sf_dir):
    """DET-X1: anomalies for processes whose absolute binary is not in the file listing."""
    p = en.with_binary_info(processes(spark, sf_dir), bodyfile(spark, sf_dir))
    a = en.detect_deleted_binaries(p)
    return a.select("collection_id", "anomaly_id", "anomaly_type", "severity", "title", "artifact_path", "username")


@register("process_conn_join")
def process_conn_join(spark, sf_dir):
    """JOIN-3: processes with their sockets (left join on collection, pid)."""
    j = en.process_connections(processes(spark, sf_dir), connections(spark, sf_dir))
    return j.select("collection_id", "source_file", "line_no", "pid", "conn_line_no", "protocol", "local_port",
                    "remote_address", "remote_port", "state")


@register("process_parent")
def process_parent(spark, sf_dir):
    """JOIN-4: parent command of each process by ppid."""
    j = en.with_parent(processes(spark, sf_dir))
    return j.select("collection_id", "source_file", "line_no", "pid", "ppid", "parent_command")


@register("process_ancestry")
def process_ancestry(spark, sf_dir):
    """JOIN-4 over all generations: root, depth and path of each listed pid."""
    found = en.process_ancestry(processes(spark, sf_dir))
    return found.select("collection_id", "pid", "root_pid", F.col("depth").cast("bigint").alias("depth"),
                        F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@register("timeline_range")
def timeline_range(spark, sf_dir):
    """FIL-7 on the merged timeline: events of an inclusive time range."""
    events = tl.filter_range(tl.log_events(event_logs(spark, sf_dir)), "2024-01-02 00:00:00", "2024-01-09 12:00:00")
    return events.select("collection_id", ts_text("timestamp").alias("timestamp"), "source_file", "line_no", "message")


PIVOT_SECONDS = 300


@register("events_around_pivot")
def events_around_pivot(spark, sf_dir):
    """JOIN-6: events of the same user within 5 minutes of each 'error' event."""
    ev = d.read_table(spark, sf_dir, "events")
    return en.events_around(ev.where(F.col("event_type") == "error"), ev, "user_id", "ts", PIVOT_SECONDS,
                            "event_id", "event_id")


@register("login_burst")
def login_burst(spark, sf_dir):
    """DET-X5: 'signup' events preceded by >= 3 'error' events of the same user within a day."""
    ev = d.read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    out = en.failures_before(ev, "user_id", "ts", et == "error", et == "signup")
    return out.select("user_id", "event_id", "failures", ts_text("ts").alias("ts"))


@register("security_tags")
def security_tags_q(spark, sf_dir):
    """TAG-1: security tags of each document (keyword substrings, rule order)."""
    docs = d.read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(txt.security_tags("text"), ",").alias("tags"))


@register("chunk_documents")
def chunk_documents(spark, sf_dir):
    """CHK-1, CHK-8, SCA-11: overlapping 1500/200 split of whole documents, repeatable ids."""
    docs = d.read_table(spark, sf_dir, "documents")
    ch = docs.select("doc_id", F.posexplode(txt.split_chunks("text")).alias("ordinal", "content"))
    return ch.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"),
                     txt.chunk_id(F.lit("doc"), F.col("content"), F.col("ordinal")).alias("chunk_id"),
                     F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("content_md5"))


def label_queries(spark, sf_dir):
    """Query vectors derived from the table: per label the centroid (variant 0)
    and the centroids of three folds of the label's vectors (variants 1..3)."""
    emb = d.read_table(spark, sf_dir, "embeddings")
    whole = ret.centroids(emb, ["label"]).withColumn("variant", F.lit(0))
    folds = ret.centroids(emb.withColumn("variant", (F.col("vec_id") % 3 + 1).cast("int")), ["label", "variant"])
    return emb, whole.unionByName(folds)


@register("vector_topk")
def vector_topk(spark, sf_dir):
    """RET-3 (+FIL-14 scope): 5 nearest vectors to each label centroid within the label."""
    emb, qs = label_queries(spark, sf_dir)
    hits = ret.knn(emb, qs.where(F.col("variant") == 0), "label", k=rules.HITS_PER_QUERY, id_col="vec_id",
                   query_cols=["label", "variant"])
    return hits.select("label", F.col("rank").cast("bigint").alias("rank"), "vec_id",
                       F.round("distance", 6).alias("distance"), F.round("score", 4).alias("score"))


@register("vector_topk_all")
def vector_topk_all(spark, sf_dir):
    """RET-3: 5 nearest of all vectors to each vector whose id is divisible by 100."""
    emb = d.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    qs = emb.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    hits = ps.knn_blocks(emb, qs, k=rules.HITS_PER_QUERY, id_col="vec_id")
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id",
                       F.round("distance", 6).alias("distance"), F.round("score", 4).alias("score"))


def _doc_hits(spark, sf_dir, k, variants):
    emb, qs = label_queries(spark, sf_dir)
    hits = ret.knn(emb, qs.where(F.col("variant").isin(variants)), "label", k=k, id_col="vec_id",
                   query_cols=["label", "variant"])
    docs = d.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", "lang")
    return hits.join(docs, "vec_id")


@register("context_pack")
def context_pack(spark, sf_dir):
    """RET-4, WIN-2: top-10 documents per label centroid packed into a 4000-token context."""
    hits = _doc_hits(spark, sf_dir, rules.HITS_FOR_CONTEXT, [0])
    packed = ret.pack_context(hits, ["label"], "text", "source", "lang", ["rank"], rules.CONTEXT_TOKEN_BUDGET)
    return packed.select("label", "n_used", "tokens_used", "context")


@register("multi_query_dedup")
def multi_query_dedup(spark, sf_dir):
    """RET-5, SET-3, SRT-3: question + 3 variants, 5 hits each, content-hash dedup
    (first hit wins), merged by score."""
    hits = _doc_hits(spark, sf_dir, rules.HITS_PER_QUERY, [0, 1, 2, 3])
    uniq = ret.dedup_hits(hits, ["label"], "text", ["variant", "rank"])
    order = Window.partitionBy("label").orderBy(F.col("distance"), "variant", "rank")
    uniq = uniq.withColumn("place", F.row_number().over(order).cast("bigint"))
    return uniq.select("label", "place", "variant", F.col("rank").cast("bigint").alias("rank"), "vec_id",
                       F.round("score", 4).alias("score"), F.md5("text").alias("content_md5"))


@register("ioc_extract")
def ioc_extract(spark, sf_dir):
    """IOC-1: every kind of indicator in document texts, page URLs and HTML and conversations, counted per
    (kind, value)."""
    docs = ioc.extract_iocs(d.read_table(spark, sf_dir, "documents"), "text", "doc_id")
    pages = d.read_table(spark, sf_dir, "pages").select("page_id", F.concat_ws("\n", "url", "html").alias("text"))
    turns = d.read_table(spark, sf_dir, "conversations")
    found = docs.unionByName(ioc.extract_iocs(pages, "text", "page_id")).unionByName(ioc.extract_iocs(turns, "text", "conv_id"))
    return ioc.ioc_summary(found)


def synthetic_answers(spark, sf_dir) -> DataFrame:
    """Markdown answers written from assistant turns (headings around the turn text)."""
    conv = d.read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    answer = F.concat(
        F.lit("# Findings\n## Executive Summary\n"), F.col("text"),
        F.lit("\n## Immediate Actions\n1. Isolate host "), F.col("conv_id").cast("string"),
        F.lit("\n2) Collect memory of turn "), F.col("turn").cast("string"),
        F.lit("\n\n- Rotate keys\n## Notes\nReviewed."))
    return conv.select("conv_id", "turn", answer.alias("answer"))


@register("answer_sections")
def answer_sections(spark, sf_dir):
    """PRM-3: executive summary text and action list cut from Markdown answers."""
    a = synthetic_answers(spark, sf_dir)
    summary = pr.extract_section("answer", "Executive Summary")
    actions = pr.action_items(pr.extract_section("answer", "Immediate"))
    return a.select("conv_id", "turn", summary.alias("summary"), F.array_join(actions, " | ").alias("actions"))


@register("prompt_table")
def prompt_table_q(spark, sf_dir):
    """PRM-1: query prompts from the packed per-label contexts."""
    ctx = context_pack(spark, sf_dir)
    question = F.concat(F.lit("Which records are closest to label "), F.col("label").cast("string"), F.lit("?"))
    return pr.prompt_table(ctx.withColumn("question", question), "query", ["label"],
                           query=F.col("question"), context=F.col("context"))


@register("followup_questions")
def followup_questions(spark, sf_dir):
    """PRM-4: follow-up suggestions for each user turn."""
    conv = d.read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return conv.select("conv_id", "turn", F.array_join(pr.followups("text"), " | ").alias("suggestions"))


@register("top_cpu")
def top_cpu(spark, sf_dir):
    """SRT-2, FIL-10: top 50 processes by cpu (> 10) and by mem (> 5) per collection."""
    p = processes(spark, sf_dir)
    out = None
    for name, col, limit in (("high_cpu", "cpu", 10), ("high_mem", "mem", 5)):
        w = Window.partitionBy("collection_id").orderBy(F.col(col).desc(), "source_file", "line_no")
        g = (p.where(F.col(col) > limit).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 50)
             .select("collection_id", F.lit(name).alias("grp"), F.col("rank").cast("bigint").alias("rank"), "pid",
                     F.col(col).alias("value")))
        out = g if out is None else out.unionByName(g)
    return out


@register("collection_summary")
def collection_summary(spark, sf_dir):
    """AGG-1 / COMPOSE-1 counts: per collection, all nine counts of the structured document."""
    from ..sinks import writers

    tables = {"bodyfile": bodyfile(spark, sf_dir), "processes": processes(spark, sf_dir), "connections": connections(spark, sf_dir),
              "users": users(spark, sf_dir), "hashes": hashes(spark, sf_dir), "logs": event_logs(spark, sf_dir)}
    tables["collections"] = spark.createDataFrame([], "collection_id string")
    return writers.summary_counts(tables)


@register("logs_by_source")
def logs_by_source(spark, sf_dir):
    """AGG-4: per log file, entry count and all entries as texts of bounded size."""
    return tl.logs_by_file(event_logs(spark, sf_dir)).select("collection_id", "source", "segment", "entry_count", "content")


@register("artifact_chunks")
def artifact_chunks(spark, sf_dir):
    """CHK-2..8, TAG-1, SET-2: every chunk producer over the derived collections."""
    logs = event_logs(spark, sf_dir)
    parts = [
        ch.file_chunks(bodyfile(spark, sf_dir)),
        ch.process_chunks(processes(spark, sf_dir)),
        ch.network_chunks(connections(spark, sf_dir)),
        ch.user_chunks(users(spark, sf_dir)),
        ch.timeline_chunks(tl.hourly_buckets(tl.log_events(logs))),
        ch.log_chunks(tl.logs_by_file(logs)),
    ]
    c = ch.all_chunks(*parts)
    return c.select("collection_id", "kind_rank", "group_rank", "segment", "chunk_id", "ordinal", "artifact_type", "source",
                    F.length("content").alias("n_chars"), F.array_join("tags", ",").alias("tags"))


@register("stream_hourly")
def stream_hourly(spark, sf_dir):
    """STR-1 + STR-2: the events table replayed as a stream, parsed as log lines,
    counted per (collection, hour); equals the batch counts."""
    from ..streaming import streams as sm

    schema = d.read_table(spark, sf_dir, "events").schema
    # the pattern meets a table kept as one file and one kept as a folder of part files
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    logs = sm.parsed_logs(d.event_log_lines(ev), reference_year=REFERENCE_YEAR)
    counts = sm.hourly_counts(logs, watermark=None)  # a replay: no row is late
    out = sm.run_available_now(counts, name="stream_hourly")
    final = sm.latest_rows(spark, out, ["collection_id", "window_start"])
    return final.select("collection_id", ts_text("window_start").alias("hour_start"), "event_count")


@register("suspicious_cron")
def suspicious_cron(spark, sf_dir):
    """DET-X2: cron log lines running temp-dir scripts or shell/encoding tricks."""
    a = en.detect_suspicious_cron(event_logs(spark, sf_dir))
    return a.select("collection_id", "anomaly_id", "anomaly_type", "severity", "description", "artifact_path")


@register("privilege_changes")
def privilege_changes(spark, sf_dir):
    """DET-X4: sudo / su log lines switching to root."""
    a = en.detect_privilege_changes(event_logs(spark, sf_dir))
    return a.select("collection_id", "anomaly_id", "anomaly_type", "severity", "description", "artifact_path")


DETECTOR_WEIGHTS = {"suspicious_user": 1.5, "hidden_file": 0.5}


@register("detector_config")
def detector_config(spark, sf_dir):
    """DET-X6: enabled types, weighted score threshold 0.7; counts per (collection, type)."""
    a = det.apply_detector_config(all_anomalies(spark, sf_dir), score_threshold=0.7, weights=DETECTOR_WEIGHTS)
    return a.groupBy("collection_id", "anomaly_type").agg(F.count(F.lit(1)).alias("n"))


@register("host_summary_chunks")
def host_summary_chunks(spark, sf_dir):
    """COMPOSE-2: one overview chunk per derived host (counts, setuid, missing binaries, listeners)."""
    ev = d.read_table(spark, sf_dir, "events")
    colls = ev.groupBy(d.host_of("user_id").alias("collection_id")).agg(F.max("ts").cast("timestamp").alias("collection_time"))
    colls = colls.select("collection_id", F.col("collection_id").alias("hostname"), F.lit("linux").alias("os_type"),
                         "collection_time")
    bf, pr_ = bodyfile(spark, sf_dir), processes(spark, sf_dir)
    logs = event_logs(spark, sf_dir)
    c = ch.summary_chunks(colls, bf, pr_, connections(spark, sf_dir), users(spark, sf_dir), logs, None,
                          en.with_binary_info(pr_, bf))
    return c.select("collection_id", "chunk_id", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))
