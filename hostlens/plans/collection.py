"""End-to-end parse of artifact collections into the engine's tables.

    archives --binaryFile + mapInPandas--> members --Column rules--> category,
    parser kind --posexplode--> lines --parsers--> bodyfile, processes,
    connections, users, hashes, logs, raw_outputs --> timeline, collections

Every table is keyed by ``collection_id``; nothing is collected to the
driver.  ``write_tables`` materialises them as Parquet partitioned by
``collection_id`` so downstream jobs (detectors, chunks, retrieval) read
pruned columns instead of re-parsing text.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..operators import timeline as tl
from ..session import ensure_engine_conf
from ..sources import archive as arc
from ..sources import structured as st
from ..sources import text_parsers as tp

TABLES = ["collections", "errors", "artifact_files", "bodyfile", "processes", "connections", "users", "hashes", "logs",
          "raw_outputs", "timeline"]


def _is_yaml(col="source_file"):
    return F.lower(col).rlike(r"\.ya?ml$")


def parse_members(members: DataFrame, reference_year=None, max_log_entries: int | None = None) -> dict[str, DataFrame]:
    """All tables of the collections whose archive members are given.

    ``reference_year`` fills the year syslog lines lack; by default the year of
    the collection time.  ``max_log_entries`` optionally keeps the first N log
    rows per collection in file order (off by default).
    """
    files = arc.catalog_members(members)
    lines = arc.member_lines(files.where(F.col("category").isin("bodyfile", "live_response", "hash", "logs")))
    collections = arc.collections_from_members(files, arc.member_lines(
        files.where(F.lower("relative_path").contains("uac.log"))))

    # file metadata (a YAML bodyfile only contributes pipe-shaped lines)
    body_lines = lines.where(F.col("category") == "bodyfile")
    body_lines = body_lines.where(~_is_yaml() | F.col("line").contains("|"))
    bodyfile = tp.parse_bodyfile(body_lines)

    live = lines.where((F.col("category") == "live_response") & ~_is_yaml())
    kind = F.col("live_kind")
    name = F.lower(F.substring_index("source_file", "/", -1))
    processes = (tp.parse_ps_aux(live.where(kind == "ps_aux"))
                 .unionByName(tp.parse_ps_ef(live.where(kind == "ps_ef")))
                 .unionByName(tp.parse_ps_generic(live.where(kind == "ps_generic"))))
    connections = (tp.parse_netstat(live.where((kind == "netstat") & name.contains("netstat")))
                   .unionByName(tp.parse_ss(live.where((kind == "netstat") & ~name.contains("netstat")))))
    users = tp.parse_passwd(live.where(kind == "passwd"))
    hashes = tp.parse_hashes(lines.where(F.col("category") == "hash"))

    log_lines = lines.where((F.col("category") == "logs") & ~_is_yaml()
                            & ~F.lower("source_file").rlike(
                                "(" + "|".join(s.replace(".", r"\.") for s in rules.BINARY_LOG_SUFFIXES) + ")$"))
    year = reference_year
    if year is None:
        log_lines = log_lines.join(collections.select("collection_id", "collection_time"), "collection_id", "left")
        year = F.coalesce(F.year("collection_time"), F.year(F.current_date()))
    logs = tp.parse_logs(log_lines, reference_year=year)

    # YAML members
    yaml_files = files.where(F.col("category").isin("live_response", "logs") & _is_yaml("relative_path"))
    records = st.yaml_records(yaml_files.where(F.col("category") == "live_response"))
    processes = processes.unionByName(st.yaml_processes(records))
    connections = connections.unionByName(st.yaml_connections(records))
    log_records = st.yaml_records(yaml_files.where(F.col("category") == "logs"))
    logs = logs.unionByName(st.yaml_logs(log_records, reference_year=reference_year if reference_year else None))
    if max_log_entries is not None:
        w = Window.partitionBy("collection_id").orderBy("source_file", "line_no")
        logs = logs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_log_entries).drop("_n")

    raw_text = files.where((F.col("category") == "live_response") & (F.col("live_kind") == "raw")
                           & F.col("content").isNotNull()).select(
        "collection_id", F.col("relative_path").alias("path"),
        arc.text_of(F.col("content")).alias("content"), F.col("part").cast("int").alias("part"))
    raw_outputs = raw_text.unionByName(st.yaml_raw_outputs(records).withColumn("part", F.lit(0)))

    timeline = tl.merge_timeline(tl.bodyfile_events(bodyfile), tl.log_events(logs), sort=False)
    return {
        "collections": collections,
        "errors": arc.archive_errors(members),
        "artifact_files": files.where(F.col("part") == 0).drop("content", "part", "first_line"),
        "bodyfile": bodyfile,
        "processes": processes,
        "connections": connections,
        "users": users,
        "hashes": hashes,
        "logs": logs,
        "raw_outputs": raw_outputs,
        "timeline": timeline,
    }


def parse_archives(spark: SparkSession, path: str, glob: str | None = None, **kw) -> dict[str, DataFrame]:
    """SRC-1 / SRC-24: parse every archive under ``path`` (one task per archive)."""
    ensure_engine_conf(spark)
    return parse_members(arc.scan_archives(spark, path, glob), **kw)


def parse_directory(spark: SparkSession, root: str, collection_id: str | None = None, **kw) -> dict[str, DataFrame]:
    """SRC-2: parse an unpacked collection folder."""
    ensure_engine_conf(spark)
    return parse_members(arc.scan_directory(spark, root, collection_id), **kw)


def load_archives(spark: SparkSession, path: str, out_dir: str, glob: str | None = None, **kw) -> dict[str, DataFrame]:
    """A full load: archives are unpacked once into ``out_dir/members`` (by category, on shared storage), all
    tables are parsed from there and written; the written tables.

    Parsers of one category read only its members' columns; what a lost executor held is read again from
    the members, not unpacked again."""
    ensure_engine_conf(spark)
    members = f"{out_dir.rstrip('/')}/members"
    unpacked = arc.scan_archives(spark, path, glob)
    unpacked.withColumn("category", arc.categorize_path("relative_path")).write.mode("overwrite").partitionBy("category").parquet(members)
    stored = spark.read.parquet(members).select(*arc.MEMBER_SCHEMA.names)
    write_tables(parse_members(stored, **kw), out_dir)
    return read_tables(spark, out_dir)


def write_tables(tables: dict[str, DataFrame], out_dir: str, mode: str = "overwrite") -> None:
    """Write each table as Parquet partitioned by ``collection_id`` (RET-1 style store).

    Rows are rebalanced by collection first: a host's rows meet in a few files, a large host's are split."""
    for name, df in tables.items():
        even = df.sparkSession.sql("SELECT /*+ REBALANCE(collection_id) */ * FROM {df}", df=df)
        even.write.mode(mode).partitionBy("collection_id").parquet(f"{out_dir.rstrip('/')}/{name}")
        # an empty table has no file to tell its columns
        df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{out_dir.rstrip('/')}/schemas/{name}")


def read_tables(spark: SparkSession, out_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of ``write_tables``, empty ones included."""
    root = out_dir.rstrip("/")

    def schema(name):
        return T.StructType.fromJson(json.loads(spark.read.text(f"{root}/schemas/{name}").first()["value"]))

    return {n: spark.read.schema(schema(n)).parquet(f"{root}/{n}") for n in (names or TABLES)}


CATEGORY_TABLES = {"bodyfile": "bodyfile", "process": "processes", "network": "connections", "user": "users",
                   "hash": "hashes", "log": "logs"}


def artifacts_by_category(tables: dict[str, DataFrame], category: str) -> DataFrame | None:
    """FIL-16: the table holding one artifact category (None for other categories)."""
    name = CATEGORY_TABLES.get(category)
    return tables.get(name) if name else None
