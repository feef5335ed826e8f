"""YAML artifacts (SRC-12, 14, 15, 19) and super-timeline CSV (SRC-20, 21).

YAML decoding is the only Python step: a ``mapInPandas`` task turns each YAML
file into flat *records* (one per document or list item) carrying either a
text block, a JSON object, or a raw-capture text.  Everything after that --
line splitting, field fallbacks, parsing -- is Column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.columns import addr_port_plain, is_digits, part, py_split_ws, py_strip
from . import text_parsers as tp

RECORD_SCHEMA = T.StructType([
    T.StructField("collection_id", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("doc_no", T.LongType()),
    T.StructField("item_no", T.LongType()),
    T.StructField("record_kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("json", T.StringType()),
    T.StructField("error", T.StringType()),
])

# record kinds
OUTPUT_TEXT = "output_text"        # dict document whose 'output' is a string
OUTPUT_MAP = "output_map"          # dict item of a dict document's 'output' list
OUTPUT_STR = "output_str"          # string item of a dict document's 'output' list
LIST_MAP = "list_map"              # dict item of a list document
LIST_STR = "list_str"              # string item of a list document
DOC_TEXT = "doc_text"              # string document
RAW = "raw"                        # raw capture text of the document
NETWORK_RAW = "network_raw"        # generic network capture text of the document


def _records_of(cid: str, path: str, text: str) -> Iterator[tuple]:
    import yaml

    try:
        docs = list(yaml.safe_load_all(text))
    except Exception as exc:  # a bad file is reported, not fatal
        yield (cid, path, None, None, "error", None, None, f"yaml: {exc}")
        return
    for d, doc in enumerate(docs):
        if doc is None:
            continue
        if isinstance(doc, dict):
            output = doc.get("output", doc)
            if isinstance(output, str):
                yield (cid, path, d, 0, OUTPUT_TEXT, output, None, None)
            elif isinstance(output, list):
                for i, item in enumerate(output):
                    if isinstance(item, dict):
                        yield (cid, path, d, i, OUTPUT_MAP, str(item), json.dumps(item, default=str), None)
                    elif isinstance(item, str):
                        yield (cid, path, d, i, OUTPUT_STR, item, None, None)
            raw_src = output
            if output:
                yield (cid, path, d, 0, NETWORK_RAW, str(output), None, None)
        else:
            raw_src = doc
            if isinstance(doc, list):
                for i, item in enumerate(doc):
                    if isinstance(item, dict):
                        yield (cid, path, d, i, LIST_MAP, str(item), json.dumps(item, default=str), None)
                    elif isinstance(item, str):
                        yield (cid, path, d, i, LIST_STR, item, None, None)
            elif isinstance(doc, str):
                yield (cid, path, d, 0, DOC_TEXT, doc, None, None)
        if raw_src:
            raw = raw_src if isinstance(raw_src, str) else yaml.dump(raw_src, default_flow_style=False)
            yield (cid, path, d, 0, RAW, raw, None, None)


def _yaml_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [f.name for f in RECORD_SCHEMA.fields]
    for pdf in batches:
        rows = []
        for cid, path, content in zip(pdf["collection_id"], pdf["relative_path"], pdf["content"]):
            text = bytes(content).decode("utf-8", errors="ignore") if content is not None else ""
            rows.extend(_records_of(cid, path, text))
        if rows:
            yield pd.DataFrame(rows, columns=cols)


def yaml_records(files: DataFrame) -> DataFrame:
    """Flatten YAML members (``collection_id, relative_path, content``) into records."""
    y = files.where(F.lower("relative_path").rlike(r"\.ya?ml$") & F.col("content").isNotNull())
    return y.select("collection_id", "relative_path", "content").mapInPandas(_yaml_batches, RECORD_SCHEMA)


def _text_lines(records: DataFrame, kinds: list[str]) -> DataFrame:
    """Lines of text records as a lines frame; ``line_no`` orders (doc, item, line)."""
    r = records.where(F.col("record_kind").isin(kinds))
    ex = r.select("collection_id", "source_file", "doc_no", "item_no",
                  F.posexplode(F.split("text", "\n", -1)).alias("_i", "line"))
    order = F.col("doc_no") * F.lit(1 << 40) + F.col("item_no") * F.lit(1 << 20) + F.col("_i")
    return ex.select("collection_id", "source_file", order.alias("line_no"), "line", F.col("_i").alias("line_in_block"))


def _j(path: str) -> Column:
    return F.get_json_object(F.col("json"), path)


def _jc(*paths: str) -> Column:
    return F.coalesce(*[_j(p) for p in paths])


def _num_or_null(c: Column, t: str) -> Column:
    return c.try_cast(t)


def yaml_processes(records: DataFrame) -> DataFrame:
    """SRC-12: processes from YAML documents under a ``process/ps`` path.

    Text output: lines after the first, 11 blank-separated fields, non-digit
    PID -> 0 (kept).  Record lists: field fallbacks user/uid, command/cmd/comm,
    cpu/%cpu, mem/%mem, stat/state, start/started.
    """
    ps = records.where(F.lower("source_file").contains("process/ps"))
    lines = _text_lines(ps, [OUTPUT_TEXT]).where(F.col("line_in_block") > 0)
    s = py_strip("line")
    p = py_split_ws(s, 11)
    text = lines.select("collection_id", "source_file", "line_no", p.alias("_p")).where(F.size("_p") >= 11)
    q = F.col("_p")

    def num(c):
        return F.when(F.regexp_replace(c, r"\.", "").rlike("^[0-9]+$"), c.try_cast("double"))

    from_text = text.select(
        "collection_id", "source_file", "line_no",
        F.when(is_digits(part(q, 1)), part(q, 1).try_cast("bigint")).otherwise(F.lit(0)).alias("pid"),
        F.lit(None).cast("bigint").alias("ppid"), part(q, 0).alias("user"),
        num(part(q, 2)).alias("cpu"), num(part(q, 3)).alias("mem"),
        F.when(is_digits(part(q, 4)), part(q, 4).try_cast("bigint")).alias("vsz"),
        F.when(is_digits(part(q, 5)), part(q, 5).try_cast("bigint")).alias("rss"),
        part(q, 6).alias("tty"), part(q, 7).alias("stat"), part(q, 8).alias("start"), part(q, 9).alias("time"),
        part(q, 10).alias("command"))
    maps = ps.where(F.col("record_kind") == OUTPUT_MAP)
    from_maps = maps.select(
        "collection_id", "source_file",
        (F.col("doc_no") * F.lit(1 << 40) + F.col("item_no") * F.lit(1 << 20)).alias("line_no"),
        F.coalesce(_num_or_null(_j("$.pid"), "bigint"), F.lit(0)).alias("pid"),
        _num_or_null(_j("$.ppid"), "bigint").alias("ppid"),
        F.coalesce(_jc("$.user", "$.uid"), F.lit("")).alias("user"),
        _num_or_null(_jc("$.cpu", "$['%cpu']"), "double").alias("cpu"),
        _num_or_null(_jc("$.mem", "$['%mem']"), "double").alias("mem"),
        _num_or_null(_j("$.vsz"), "bigint").alias("vsz"), _num_or_null(_j("$.rss"), "bigint").alias("rss"),
        _j("$.tty").alias("tty"), _jc("$.stat", "$.state").alias("stat"), _jc("$.start", "$.started").alias("start"),
        _j("$.time").alias("time"), F.coalesce(_jc("$.command", "$.cmd", "$.comm"), F.lit("")).alias("command"))
    return from_text.unionByName(from_maps)


def yaml_connections(records: DataFrame) -> DataFrame:
    """SRC-14: connections from YAML documents under ``network/netstat`` or ``network/ss``.

    Text output: every line except blank / 'Active' / 'Proto' lines, no protocol
    filter, plain last-':' address split, state = 6th field or '', no pid.
    """
    low = F.lower("source_file")
    net = records.where(low.contains("network/netstat") | low.contains("network/ss"))
    lines = _text_lines(net, [OUTPUT_TEXT])
    s = py_strip("line")
    t = lines.select("collection_id", "source_file", "line_no", s.alias("_l")).where(
        (F.col("_l") != "") & ~F.col("_l").startswith("Active") & ~F.col("_l").startswith("Proto"))
    t = t.select("*", py_split_ws(F.col("_l")).alias("_p")).where(F.size("_p") >= 4)
    q = F.col("_p")
    la, ra = addr_port_plain(part(q, 3)), addr_port_plain(F.coalesce(part(q, 4), F.lit("")))
    from_text = t.select(
        "collection_id", "source_file", "line_no", part(q, 0).alias("protocol"),
        la["address"].alias("local_address"), la["port"].alias("local_port"),
        ra["address"].alias("remote_address"), ra["port"].alias("remote_port"),
        F.coalesce(part(q, 5), F.lit("")).alias("state"),
        F.lit(None).cast("int").alias("pid"), F.lit(None).cast("string").alias("program"))
    maps = net.where(F.col("record_kind") == OUTPUT_MAP)
    from_maps = maps.select(
        "collection_id", "source_file",
        (F.col("doc_no") * F.lit(1 << 40) + F.col("item_no") * F.lit(1 << 20)).alias("line_no"),
        F.coalesce(_jc("$.proto", "$.protocol"), F.lit("tcp")).alias("protocol"),
        F.coalesce(_jc("$.local_address", "$.local"), F.lit("")).alias("local_address"),
        F.coalesce(_num_or_null(_j("$.local_port"), "int"), F.lit(0)).alias("local_port"),
        F.coalesce(_jc("$.remote_address", "$.foreign"), F.lit("")).alias("remote_address"),
        F.coalesce(_num_or_null(_j("$.remote_port"), "int"), F.lit(0)).alias("remote_port"),
        F.coalesce(_j("$.state"), F.lit("")).alias("state"),
        _num_or_null(_j("$.pid"), "int").alias("pid"),
        F.coalesce(_jc("$.program", "$.process"), F.lit("")).alias("program"))
    return from_text.unionByName(from_maps)


def yaml_raw_outputs(records: DataFrame) -> DataFrame:
    """SRC-15: raw captures of YAML documents that no parser above takes.

    Generic ``network/`` files keep ``str(output)`` per document; other files
    keep the text (YAML re-dumped when not a string); the last document of a
    path wins, as later documents overwrite earlier ones.
    """
    low = F.lower("source_file")
    parsed = low.contains("process/ps") | low.contains("network/netstat") | low.contains("network/ss")
    generic_net = low.contains("network/")
    r = records.where(~parsed & (
        (generic_net & (F.col("record_kind") == NETWORK_RAW)) | (~generic_net & (F.col("record_kind") == RAW))))
    keyed = r.select("collection_id", F.when(generic_net, F.concat(F.col("source_file"), F.lit("#"),
                                                                   F.col("doc_no").cast("string")))
                     .otherwise(F.col("source_file")).alias("path"), "doc_no", "text")
    return keyed.groupBy("collection_id", "path").agg(F.max_by("text", "doc_no").alias("content"))


def yaml_logs(records: DataFrame, reference_year=None) -> DataFrame:
    """SRC-19: log rows from YAML log files.

    Text blocks (document ``output`` strings and string documents) are parsed
    line by line like text logs; string list items are parsed whole; map items
    become ``log_type='yaml'`` rows with message from message/msg, and -- for
    items of a document's ``output`` list only -- host, pid and time.
    """
    blocks = _text_lines(records, [OUTPUT_TEXT, DOC_TEXT]).drop("line_in_block")
    items = records.where(F.col("record_kind").isin(OUTPUT_STR, LIST_STR)).select(
        "collection_id", "source_file",
        (F.col("doc_no") * F.lit(1 << 40) + F.col("item_no") * F.lit(1 << 20)).alias("line_no"),
        F.col("text").alias("line"))
    parsed = tp.parse_logs(blocks.unionByName(items), reference_year=reference_year)
    maps = records.where(F.col("record_kind").isin(OUTPUT_MAP, LIST_MAP))
    in_output = F.col("record_kind") == OUTPUT_MAP
    ts_txt = _jc("$.timestamp", "$.time", "$['@timestamp']")
    from_maps = maps.select(
        "collection_id", "source_file",
        (F.col("doc_no") * F.lit(1 << 40) + F.col("item_no") * F.lit(1 << 20)).alias("line_no"),
        F.when(in_output, ts_txt.try_cast("timestamp")).alias("timestamp"),
        F.col("text").alias("raw_line"), F.lit("yaml").alias("log_type"),
        F.when(in_output, _jc("$.hostname", "$.host")).alias("hostname"),
        F.lit(None).cast("string").alias("process"),
        F.when(in_output, _num_or_null(_j("$.pid"), "bigint")).alias("pid"),
        F.coalesce(_jc("$.message", "$.msg"), F.col("text")).alias("message"))
    return parsed.unionByName(from_maps)


# ---------------------------------------------------------------------------
# SRC-20 / SRC-21 super-timeline CSV
# ---------------------------------------------------------------------------
L2T_COLUMNS = ["date", "time", "timezone", "MACB", "source", "sourcetype", "type", "user", "host", "short", "desc",
               "version", "filename", "inode", "notes", "format", "extra"]


def read_l2t_csv(spark: SparkSession, path: str, collection_id: str | None = None) -> DataFrame:
    """SRC-20: L2T CSV rows; absent columns are '' (timezone 'UTC'); time from
    ``MM/dd/yyyy HH:mm:ss`` or NULL.  All columns are read as text."""
    raw = spark.read.option("header", "true").option("inferSchema", "false").option("mode", "PERMISSIVE").csv(path)
    present = set(raw.columns)
    cols = []
    for c in L2T_COLUMNS:
        default = "UTC" if c == "timezone" else ""
        cols.append((F.coalesce(F.col(f"`{c}`"), F.lit(default)) if c in present else F.lit(default)).alias(c))
    df = raw.select(*cols, F.col("_metadata.file_path").alias("source_file"))
    ts = F.when((F.col("date") != "") & (F.col("time") != ""),
                F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("MM/dd/yyyy HH:mm:ss")))
    cid = F.lit(collection_id) if collection_id else F.regexp_extract("source_file", r"([^/]+?)(\.[^./]*)?$", 1)
    return df.select(cid.alias("collection_id"), "*", ts.alias("timestamp"))


def l2t_timeline(events: DataFrame) -> DataFrame:
    """SRC-21: super-timeline rows as timeline events (rows without time dropped)."""
    from ..operators.timeline import TIMELINE_COLS
    out = events.where(F.col("timestamp").isNotNull()).select(
        "collection_id", "timestamp",
        F.col("type").alias("timestamp_desc"),
        F.col("source").alias("source"),
        F.col("sourcetype").alias("source_type"),
        F.concat(F.col("desc"), F.lit(" ("), F.col("filename"), F.lit(")")).alias("message"),
        F.col("filename").alias("artifact_path"),
        F.col("host").alias("hostname"),
        F.lit(None).cast("bigint").alias("pid"),
        F.create_map(F.lit("macb"), F.col("MACB"), F.lit("user"), F.col("user")).alias("extra_data"),
        F.lit(0).alias("group_rank"), "source_file",
        F.monotonically_increasing_id().alias("line_no"), F.lit(0).alias("sub_rank"))
    return out.select(*TIMELINE_COLS)
