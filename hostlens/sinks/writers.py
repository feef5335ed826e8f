"""Sinks: JSON lines, JSON, CSV and Markdown outputs (SNK-1..10, COMPOSE-1/2).

Writers emit one row per record through Spark's text/CSV/JSON writers,
partitioned by ``collection_id``; documents that are conceptually one file
(reports) are written as ordered rows of a sorted frame, so no report is ever
built as one string in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import iso_text
from ..operators import timeline as tl
from ..operators.numbering import numbered


def write_timesketch_jsonl(timeline: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-1: Timesketch JSON lines (extra data merged over the fixed keys)."""
    rows = tl.timesketch_rows(timeline)
    rows.select("collection_id", F.to_json("record").alias("value")).write.mode(mode).partitionBy(
        "collection_id").text(path)


def bodyfile_csv_frame(bodyfile: DataFrame) -> DataFrame:
    """SNK-3 columns: the 11 raw fields plus ISO text of the four times."""
    out = bodyfile.select("collection_id", "md5", "name", "inode", "mode", "uid", "gid", "size",
                          "atime", "mtime", "ctime", "crtime")
    for c in ("atime", "mtime", "ctime", "crtime"):
        out = out.withColumn(f"{c}_iso", iso_text(F.when(F.col(c) > 0, F.timestamp_seconds(c))))
    return out


def write_bodyfile_csv(bodyfile: DataFrame, path: str, mode: str = "overwrite") -> None:
    bodyfile_csv_frame(bodyfile).write.mode(mode).option("header", "true").partitionBy("collection_id").csv(path)


def write_chunks_jsonl(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-5: chunk records as JSON lines."""
    from ..operators.chunks import chunk_records
    chunk_records(chunks).drop("tags_text").write.mode(mode).json(path)


def anomalies_csv_frame(anomalies: DataFrame) -> DataFrame:
    """SNK-6 columns."""
    return anomalies.select("collection_id", F.col("anomaly_id").alias("id"), F.col("anomaly_type").alias("type"),
                            "severity", "score", "title", "description",
                            F.col("source_artifact").alias("artifact"))


def write_anomalies_csv(anomalies: DataFrame, path: str, mode: str = "overwrite") -> None:
    anomalies_csv_frame(anomalies).write.mode(mode).option("header", "true").partitionBy("collection_id").csv(path)


def _evidence_md(items: int | None = None, chars: int | None = None) -> F.Column:
    """All evidence as Markdown; ``items`` and ``chars`` shorten the list and the raw texts."""
    def one(e):
        head = F.concat(F.lit("**"), e["artifact_type"], F.lit("**"),
                        F.when(e["artifact_path"].isNotNull(), F.concat(F.lit(" (`"), e["artifact_path"], F.lit("`)")))
                        .otherwise(F.lit("")), F.lit("\n"))
        expl = F.when(e["explanation"].isNotNull(), F.concat(F.lit("- "), e["explanation"], F.lit("\n"))).otherwise(F.lit(""))
        text = e["raw_data"] if chars is None else F.concat(
            F.substring(e["raw_data"], 1, chars), F.when(F.length(e["raw_data"]) > chars, F.lit("...")).otherwise(F.lit("")))
        raw = F.when(e["raw_data"].isNotNull() & (e["raw_data"] != ""), F.concat(
            F.lit("```\n"), text, F.lit("\n```\n"))).otherwise(F.lit(""))
        return F.concat(head, expl, raw, F.lit("\n"))
    return F.array_join(F.transform("evidence" if items is None else F.slice("evidence", 1, items), one), "")


def anomaly_markdown(anomalies: DataFrame) -> DataFrame:
    """SNK-7 per-anomaly Markdown block (heading, severity line, context, evidence, steps)."""
    mark = F.element_at(F.create_map(*[x for k, v in rules.SEVERITY_MARK.items() for x in (F.lit(k), F.lit(v))]),
                        F.col("severity"))
    score2 = F.format_string("%.2f", F.col("score"))
    steps = F.array_join(F.transform("investigation_steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s,
                                                                              F.lit("\n"))), "")
    md = F.concat(
        F.lit("### "), F.coalesce(mark, F.lit("⚪")), F.lit(" "), F.col("title"), F.lit("\n\n"),
        F.lit("**Severity:** "), F.upper("severity"), F.lit(" | **Score:** "), score2, F.lit(" | **Type:** "),
        F.col("anomaly_type"), F.lit("\n\n"), F.col("description"), F.lit("\n\n"),
        F.when(F.col("source_artifact").isNotNull(), F.concat(F.lit("**Source:** `"), F.col("source_artifact"), F.lit("`\n"))).otherwise(F.lit("")),
        F.when(F.col("timestamp").isNotNull(), F.concat(F.lit("**Timestamp:** "), iso_text("timestamp"), F.lit("\n"))).otherwise(F.lit("")),
        F.when(F.col("username").isNotNull(), F.concat(F.lit("**User:** "), F.col("username"), F.lit("\n"))).otherwise(F.lit("")),
        F.when(F.col("process_name").isNotNull(), F.concat(F.lit("**Process:** "), F.col("process_name"), F.lit("\n"))).otherwise(F.lit("")),
        F.when(F.size("evidence") > 0, F.concat(F.lit("\n#### Evidence\n\n"), _evidence_md())).otherwise(F.lit("")),
        F.when(F.size("investigation_steps") > 0, F.concat(F.lit("\n#### Investigation Steps\n\n"), steps)).otherwise(F.lit("")),
        F.lit("\n---\n\n"),
    )
    return anomalies.select("*", md.alias("markdown"))


def anomaly_report_rows(anomalies: DataFrame, counts: DataFrame, hostnames: DataFrame | None = None) -> DataFrame:
    """SNK-7: report as ordered rows ``(collection_id, part, seq..., text)``.

    Header and severity table come from the per-collection counts; critical,
    high and medium anomalies follow in rank order under their section
    headings (low and info are only counted).  Write with ``write_report``.
    """
    from ..functions.columns import severity_rank
    c = counts
    if hostnames is not None:
        c = c.join(hostnames.select("collection_id", "hostname"), "collection_id", "left")
    else:
        c = c.withColumn("hostname", F.lit(None).cast("string"))
    header = F.concat(
        F.lit(rules.FORMATS["report_header"]), F.lit("**Source:** `"), F.col("collection_id"), F.lit("`\n"),
        F.when(F.col("hostname").isNotNull(), F.concat(F.lit("**Hostname:** "), F.col("hostname"), F.lit("\n"))).otherwise(F.lit("")),
        F.lit("\n## Summary\n\n| Severity | Count |\n|----------|-------|\n"),
        F.lit("| 🔴 Critical | "), F.col("critical").cast("string"), F.lit(" |\n"),
        F.lit("| 🟠 High | "), F.col("high").cast("string"), F.lit(" |\n"),
        F.lit("| 🟡 Medium | "), F.col("medium").cast("string"), F.lit(" |\n"),
        F.lit("| 🟢 Low | "), F.col("low").cast("string"), F.lit(" |\n"),
        F.lit("| 🔵 Info | "), F.col("info").cast("string"), F.lit(" |\n"),
        F.lit("| **Total** | **"), F.col("total").cast("string"), F.lit("** |\n\n"),
    )
    head_rows = c.select("collection_id", F.lit(0).alias("part"), F.lit(0).alias("sev"), F.lit(0.0).alias("neg_score"),
                         F.lit(None).cast("struct<g:int,r0:int,f:string,n:bigint,r:int>").alias("ord"), header.alias("text"))
    titles = rules.FORMATS["report_sections"]
    shown = anomaly_markdown(anomalies.where(F.col("severity").isin(*titles)))
    body = shown.select("collection_id", F.lit(2).alias("part"), (-severity_rank("severity")).alias("sev"),
                        (-F.col("score")).alias("neg_score"), "ord", F.col("markdown").alias("text"))
    sec_src = c.select("collection_id", "critical", "high", "medium")
    secs = None
    for s, title in titles.items():
        r = sec_src.where(F.col(s) > 0).select(
            "collection_id", F.lit(1).alias("part"), F.lit(-rules.severity_rank(s)).alias("sev"),
            F.lit(-2.0).alias("neg_score"), F.lit(None).cast("struct<g:int,r0:int,f:string,n:bigint,r:int>").alias("ord"),
            F.lit(title).alias("text"))
        secs = r if secs is None else secs.unionByName(r)
    out = head_rows.unionByName(secs).unionByName(body)
    # section heading sorts right before its anomalies: order by (sev, part) after the header
    return out.withColumn("_k", F.when(F.col("part") == 0, F.lit(-100)).otherwise(F.col("sev")))


def write_report(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write report rows in order, one text folder per collection (range-partitioned sort)."""
    ordered = rows.orderBy("collection_id", "_k", "part", "neg_score", "ord")
    ordered.select("collection_id", "text").write.mode(mode).partitionBy("collection_id").text(path)


def timeline_plot_table(timeline: DataFrame, max_events: int | None = None, message_chars: int | None = None) -> DataFrame:
    """SNK-9: the plot's columns for every event; ``max_events`` per collection in time order and
    ``message_chars`` thin the plot when asked for."""
    t = timeline
    if max_events is not None:
        w = Window.partitionBy("collection_id").orderBy(*tl.ORDER_COLS)
        t = t.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_events)
    message = F.col("message") if message_chars is None else F.substring("message", 1, message_chars)
    return t.select("collection_id", "timestamp", "source_type", "source", message.alias("message"))


def parse_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """SNK-10: row count per (collection, table)."""
    out = None
    for name, df in tables.items():
        if "collection_id" not in df.columns:
            continue
        c = df.groupBy("collection_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out


def sample_rows(df: DataFrame, order_cols: list[str], n: int = 10) -> DataFrame:
    """SNK-10 samples: first ``n`` rows per collection in the given order."""
    w = Window.partitionBy("collection_id").orderBy(*order_cols)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def summary_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """The nine counts of the structured document, one row per collection: a row per artifact reduced to
    (collection, kind) flags, all kinds in one union and one conditional aggregate."""
    mode = F.col("mode")
    flags = {
        "bodyfile": {"executable_files": mode.contains("x") & ~mode.startswith("d"), "setuid_files": F.lower(mode).contains("s"),
                     "total_files": F.lit(True)},
        "processes": {"processes": F.lit(True)}, "connections": {"network_connections": F.lit(True)},
        "users": {"users": F.lit(True)}, "hashes": {"hash_entries": F.lit(True)}, "logs": {"log_entries": F.lit(True)},
    }
    names = [n for kind in flags.values() for n in kind]
    mtime, crtime = F.col("mtime"), F.col("crtime")
    events = {"bodyfile": F.when(mtime > 0, 1).otherwise(0) + F.when((crtime > 0) & ((mtime <= 0) | (crtime != mtime)), 1).otherwise(0),
              "logs": F.col("timestamp").isNotNull().cast("int")}
    out = tables["collections"].select("collection_id", *[F.lit(0).alias(n) for n in names], F.lit(0).alias("timeline_events"))
    for table, kinds in flags.items():
        if tables.get(table) is not None:
            out = out.unionByName(tables[table].select(
                "collection_id", *[kinds.get(n, F.lit(False)).cast("int").alias(n) for n in names],
                events.get(table, F.lit(0)).cast("int").alias("timeline_events")))
    return out.groupBy("collection_id").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in [*names, "timeline_events"]])


def structured_data(tables: dict[str, DataFrame], limit: int | None = None, command_chars: int | None = None) -> DataFrame:
    """COMPOSE-1: per collection the structured document (as JSON text): metadata, the summary counts and the
    host's processes, sockets, accounts and suspicious files.

    One host's lists are one value by the document's definition; ``limit`` and ``command_chars`` shorten them
    when asked for.  Empty lists and unknown fields stay in the document."""
    from ..operators import files as fl

    def listed(df, cols):
        w = Window.partitionBy("collection_id").orderBy("source_file", "line_no")
        r = df.withColumn("_n", F.row_number().over(w))
        r = r if limit is None else r.where(F.col("_n") <= limit)
        agg = r.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*cols).alias("v")))).alias("items"))
        return agg.select("collection_id", F.transform("items", lambda x: x["v"]).alias("items"))

    def file_items(df, kind, size, mtime):
        return df.select("collection_id", "source_file", "line_no", F.lit(kind).alias("type"), F.col("name").alias("path"), "mode",
                         size.alias("size"), mtime.alias("mtime"))

    bf, pr, cn, us = tables["bodyfile"], tables["processes"], tables["connections"], tables["users"]
    command = F.coalesce("command", F.lit(""))
    command = command if command_chars is None else F.substring(command, 1, command_chars)
    procs = listed(pr.withColumn("command", command), ["pid", "ppid", "user", "command", "cpu", "mem"])
    conns = listed(cn.select("collection_id", "source_file", "line_no", "protocol",
                             F.concat_ws(":", "local_address", F.col("local_port").cast("string")).alias("local"),
                             F.when(F.coalesce("remote_address", F.lit("")) != "",
                                    F.concat_ws(":", "remote_address", F.col("remote_port").cast("string"))).alias("remote"),
                             "state", "pid", "program"),
                   ["protocol", "local", "remote", "state", "pid", "program"])
    kind = ["type", "path", "mode", "size", "mtime"]
    setuid = listed(file_items(fl.setuid_files(bf), "setuid", F.col("size"), F.lit(None).cast("string")), kind)
    in_temp = F.array_contains(F.array(*[F.col("name").contains(p) for p in rules.FILE_TEMP_DIRS]), True)
    tmp_ex = listed(file_items(fl.executables(bf).where(in_temp), "executable_unusual_location", F.lit(None).cast("bigint"),
                               iso_text(F.when(F.col("mtime") > 0, F.timestamp_seconds("mtime")))), kind)
    users = listed(us.withColumn("is_system", F.col("is_system_user")), ["username", "uid", "shell", "home", "is_system", "has_valid_shell"])
    doc = tables["collections"]
    for name, part in (("processes", procs), ("network", conns), ("users", users), ("setuid", setuid), ("tmp_exec", tmp_ex)):
        doc = doc.join(part.withColumnRenamed("items", name), "collection_id", "left")
    counts = summary_counts(tables)
    counts = counts.select("collection_id", F.struct(*[c for c in counts.columns if c != "collection_id"]).alias("summary"))
    doc = doc.join(counts, "collection_id", "left")

    def whole(name):
        return F.coalesce(name, F.array().cast(doc.schema[name].dataType)).alias(name)

    return doc.select("collection_id", F.to_json(F.struct(
        F.struct("hostname", "os_type", iso_text("collection_time").alias("collection_time")).alias("metadata"),
        F.col("summary"), whole("processes"), whole("network"), whole("users"),
        F.concat(whole("setuid"), whole("tmp_exec")).alias("suspicious_files"),
    ), {"ignoreNullFields": "false"}).alias("json"))


def markdown_export(chunks: DataFrame, hostnames: DataFrame, n: int | None = None) -> DataFrame:
    """SNK-4: per collection a header and its chunks (producer order; with ``n`` the first), as ordered rows."""
    order = ["kind_rank", "group_rank", "segment", "ordinal", "chunk_id"]
    if n is None:
        body = numbered(chunks.select("collection_id", *order, "artifact_type", "source", "content"), ["collection_id"], order, "_n")
    else:
        body = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("collection_id").orderBy(*order))).where(F.col("_n") <= n)
    body = body.select("collection_id", F.col("_n").alias("seq"), F.concat(
        F.lit("## "), F.col("artifact_type"), F.lit(" — "), F.col("source"), F.lit("\n\n"), F.col("content"),
        F.lit("\n\n")).alias("text"))
    taken = (F.when(F.col("collection_time").isNotNull(), F.concat(F.lit("**Collection Time:** "), iso_text("collection_time"), F.lit("\n\n")))
             .otherwise(F.lit("")) if "collection_time" in hostnames.columns else F.lit(""))
    head = hostnames.select("collection_id", F.lit(0).alias("seq"), F.concat(
        F.lit("# Forensic export: "), F.coalesce("hostname", F.lit("Unknown")), F.lit("\n\n**Source:** "), F.col("collection_id"),
        F.lit("\n\n"), taken).alias("text"))
    return head.unionByName(body)


def incident_report_rows(collections: DataFrame, anomalies: DataFrame, iocs: DataFrame | None = None,
                         answers: DataFrame | None = None, confidence: str = "medium") -> DataFrame:
    """SNK-8 incident report as ordered rows ``(collection_id, seq, sub, text)``.

    ``answers`` (collection_id, summary, actions array) come from the answer
    post-processing (PRM-3); ``iocs`` (collection_id, kind, value) are all
    listed, in texts of bounded size; techniques are the distinct MITRE ids of the anomalies.
    """
    head = collections.select("collection_id", F.lit(0).alias("seq"), F.concat(
        F.lit("# Incident Report: Forensic Analysis: "), F.coalesce("hostname", F.lit("Unknown Host")),
        F.lit("\n\n## Executive Summary\n\n")).alias("text"))
    parts = [head]
    if answers is not None:
        parts.append(answers.select("collection_id", F.lit(1).alias("seq"),
                                    F.concat(F.coalesce("summary", F.lit("")), F.lit("\n\n")).alias("text")))
        acts = answers.where(F.size("actions") > 0).select("collection_id", F.lit(7).alias("seq"), F.concat(
            F.lit("## Immediate Actions Required\n\n"),
            F.array_join(F.transform("actions", lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a, F.lit("\n"))), ""),
            F.lit("\n")).alias("text"))
        parts.append(acts)
    parts.append(collections.where(F.col("collection_time").isNotNull()).select(
        "collection_id", F.lit(2).alias("seq"),
        F.concat(F.lit("## Timeline\n\n**Start:** "), iso_text("collection_time"), F.lit("\n\n")).alias("text")))
    parts.append(collections.where(F.col("hostname").isNotNull()).select(
        "collection_id", F.lit(3).alias("seq"),
        F.concat(F.lit("## Impact\n\n**Affected Hosts:** "), F.col("hostname"), F.lit("\n\n")).alias("text")))
    if iocs is not None:
        found = iocs.select("collection_id", "kind", "value").distinct()
        parts.append(found.select("collection_id").distinct().select("collection_id", F.lit(4).alias("seq"), F.lit(
            "## Indicators of Compromise (IOCs)\n\n").alias("text")))
        texts = tl.segment_texts(found, ["collection_id", "kind"], ["value"], F.concat(F.lit("- `"), F.col("value"), F.lit("`\n")))
        parts.append(texts.select("collection_id", F.lit(4).alias("seq"), F.concat(F.col("kind"), F.format_string(" %08d", "segment")).alias("sub"),
                                  F.concat(F.lit("### "), F.col("kind"), F.lit("\n"), F.col("_text"), F.lit("\n")).alias("text")))
    tech = anomalies.where(F.col("mitre_technique").isNotNull()).groupBy("collection_id").agg(
        F.array_sort(F.collect_set("mitre_technique")).alias("_t"))
    parts.append(tech.select("collection_id", F.lit(6).alias("seq"), F.concat(
        F.lit("## MITRE ATT&CK Techniques\n\n"), F.array_join(F.transform("_t", lambda t: F.concat(F.lit("- "), t, F.lit("\n"))), ""),
        F.lit("\n")).alias("text")))
    parts.append(collections.select("collection_id", F.lit(9).alias("seq"),
                                    F.lit(f"---\n*Confidence Level: {confidence}*\n").alias("text")))
    out = None
    for p in parts:
        p = p if "sub" in p.columns else p.withColumn("sub", F.lit(""))
        out = p if out is None else out.unionByName(p)
    return out.select("collection_id", "seq", "sub", "text")


def query_result_markdown(results: DataFrame) -> DataFrame:
    """SNK-8 query result: ``(query_id, query, answer, confidence, evidence array, suggestions array)``
    -> Markdown text per query."""
    conf = F.format_string("%.2f", F.col("confidence"))
    ev = F.array_join(F.transform("evidence", lambda e: F.concat(
        F.lit("**"), e["artifact_type"], F.lit("**"),
        F.when(e["artifact_path"].isNotNull(), F.concat(F.lit(" (`"), e["artifact_path"], F.lit("`)"))).otherwise(F.lit("")),
        F.lit("\n"), F.when(e["raw_data"].isNotNull(), F.concat(F.lit("```\n"), e["raw_data"], F.lit("\n```\n"))).otherwise(F.lit("")), F.lit("\n"))), "")
    sugg = F.array_join(F.transform("suggestions", lambda q: F.concat(F.lit("- "), q, F.lit("\n"))), "")
    md = F.concat(
        F.lit("## Query: "), F.col("query"), F.lit("\n\n**Confidence:** "), conf, F.lit("\n\n### Answer\n\n"),
        F.col("answer"), F.lit("\n\n"),
        F.when(F.size("evidence") > 0, F.concat(F.lit("### Supporting Evidence\n\n"), ev)).otherwise(F.lit("")),
        F.when(F.size("suggestions") > 0, F.concat(F.lit("### Suggested Follow-up Queries\n\n"), sugg)).otherwise(F.lit("")))
    return results.select("query_id", md.alias("markdown"))
