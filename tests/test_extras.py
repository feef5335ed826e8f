"""Helpers around the main operators: summaries, reports, joins, flat files, streaming detectors."""

from __future__ import annotations

import datetime as dt
import json

from conftest import lines_df
from pyspark.sql import functions as F

from hostlens.operators import chunks as ch
from hostlens.operators import detectors as det
from hostlens.operators import enrich as en
from hostlens.operators import timeline as tl
from hostlens.plans import collection as col
from hostlens.sinks import writers as w
from hostlens.sources import archive as arc
from hostlens.sources import text_parsers as tp
from hostlens.streaming import streams as sm

BODY = "\n".join(["0|/usr/bin/su|1|-rwsr-xr-x|0|0|1|1|1700000000|1|1", "abc|/opt/x|2|-rwxr-xr-x|0|0|1|1|5|1|1"])
PS = "USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND\nroot 5 0 0 1 1 ? S 0 0 /opt/gone -d"
NET = "Proto a b Local Foreign State PID\ntcp 0 0 0.0.0.0:22 0.0.0.0:* LISTEN 5/gone"


def _tables(spark):
    bf = tp.parse_bodyfile(lines_df(spark, BODY, "bodyfile.txt"))
    pr = tp.parse_ps_aux(lines_df(spark, PS, "ps_aux.txt"))
    cn = tp.parse_netstat(lines_df(spark, NET, "netstat.txt"))
    us = tp.parse_passwd(lines_df(spark, "root:x:0:0::/root:/bin/bash\ntoor:x:0:0::/:/bin/sh\nsvc:x:9:9::/:/bin/sh",
                                  "passwd"))
    logs = tp.parse_logs(lines_df(spark, "Jan  1 00:00:00 h p[1]: m", "/var/log/syslog"), reference_year=2024)
    colls = spark.createDataFrame([("c1", "host1", "linux", dt.datetime(2024, 1, 1))],
                                  "collection_id string, hostname string, os_type string, collection_time timestamp")
    return colls, bf, pr, cn, us, logs


def test_summary_chunk(spark):
    colls, bf, pr, cn, us, logs = _tables(spark)
    t = tl.merge_timeline(tl.bodyfile_events(bf), tl.log_events(logs), sort=False)
    c = ch.summary_chunks(colls, bf, pr, cn, us, logs, t, en.with_binary_info(pr, bf)).first()
    assert c.content.startswith("# System Analysis Summary\n\n## System Information\n- Hostname: host1\n")
    assert "- SUID/SGID Files: 1\n" in c.content and "- Timeline Events: 5" in c.content
    assert "### Processes Without Binary on Disk\n- PID 5: /opt/gone -d\n" in c.content
    assert "### Listening Services\n- tcp 0.0.0.0:22 (gone)\n" in c.content
    assert c.tags[-2:] == ["overview", "summary"]


def test_reports_and_config(spark):
    colls, bf, pr, cn, us, logs = _tables(spark)
    a = det.detect_all(pr, cn, bf, us)
    cfg = det.apply_detector_config(a, score_threshold=0.75, weights={"suspicious_user": 0.5})
    assert sorted(r.anomaly_type for r in cfg.collect()) == ["privilege_escalation"]
    answers = spark.createDataFrame([("c1", "It was bad.", ["Isolate", "Patch"])],
                                    "collection_id string, summary string, actions array<string>")
    iocs = spark.createDataFrame([("c1", "ipv4", "1.2.3.4")], "collection_id string, kind string, value string")
    rows = w.incident_report_rows(colls, a, iocs, answers).orderBy("seq").collect()
    md = "".join(r.text for r in rows)
    assert md.startswith("# Incident Report: Forensic Analysis: host1\n\n## Executive Summary\n\nIt was bad.")
    assert "## MITRE ATT&CK Techniques\n\n- T1136\n" in md
    assert "### ipv4\n- `1.2.3.4`\n" in md and "1. Isolate\n2. Patch\n" in md and md.endswith("*Confidence Level: medium*\n")
    q = spark.createDataFrame([("q1", "what?", "answer", 0.7, [], ["next?"])],
                              "query_id string, query string, answer string, confidence double, "
                              "evidence array<struct<artifact_type:string,artifact_path:string,raw_data:string>>, "
                              "suggestions array<string>")
    assert w.query_result_markdown(q).first().markdown == (
        "## Query: what?\n\n**Confidence:** 0.70\n\n### Answer\n\nanswer\n\n### Suggested Follow-up Queries\n\n- next?\n")


def test_joins_and_summaries(spark):
    colls, bf, pr, cn, us, logs = _tables(spark)
    hashes = tp.parse_hashes(lines_df(spark, "d41d8cd98f00b204e9800998ecf8427e /opt/x", "h.md5"))
    mm = en.hash_mismatches(hashes, bf).collect()
    assert [(r.name, r.listed_md5, r.file_md5) for r in mm] == [("/opt/x", "d41d8cd98f00b204e9800998ecf8427e", "abc")]
    iocs = spark.createDataFrame([("/opt/x",)], "value string")
    assert [r.name for r in en.ioc_matches(bf, "name", iocs).collect()] == ["/opt/x"]
    a = det.detect_all(pr, cn, bf, us)
    scored = en.anomaly_scores(pr, a, "pid", "process_name").collect()
    assert scored[0].anomaly_score is None  # process_name does not key pids
    ext = tl.log_events(logs).withColumn("source", F.lit("ext"))
    internal = tl.merge_timeline(tl.bodyfile_events(bf), sort=False)
    chosen = tl.prefer_external(ext, internal).collect()
    assert {r.source for r in chosen} == {"ext"}
    plot = w.timeline_plot_table(tl.merge_timeline(tl.bodyfile_events(bf), sort=False), max_events=1).collect()
    assert len(plot) == 1
    summ = {r.table: r.rows for r in w.parse_summary({"bodyfile": bf, "processes": pr}).collect()}
    assert summ == {"bodyfile": 2, "processes": 1}
    doc = json.loads(w.structured_data({"collections": colls, "bodyfile": bf, "processes": pr, "connections": cn,
                                        "users": us}).first().json)
    assert doc["metadata"]["hostname"] == "host1" and doc["processes"][0]["pid"] == 5
    assert doc["suspicious_files"][0]["type"] == "setuid" and doc["network"][0]["local"] == "0.0.0.0:22"
    assert col.artifacts_by_category({"processes": pr}, "process") is pr


def test_flat_files_and_directory(spark, tmp_path):
    d = tmp_path / "uac-h-linux-20240101000000"
    (d / "live_response" / "process").mkdir(parents=True)
    (d / "live_response" / "process" / "ps_auxwww.txt").write_text(PS + "\n")
    (d / "big.log").write_text("header\n" + "".join(f"line {i}\n" for i in range(5000)))
    lines = arc.read_text_lines(spark, str(d), glob="*.log").orderBy("line_no").collect()
    assert lines[0].line_no == 0 and lines[0].line == "header" and len(lines) == 5001
    assert [r.line for r in lines[1:4]] == ["line 0", "line 1", "line 2"]
    t = col.parse_directory(spark, str(d))
    assert [r.pid for r in t["processes"].collect()] == [5]


def test_streaming_detectors(spark, tmp_path):
    d = tmp_path / "c9"
    d.mkdir()
    (d / "auth.log").write_text("\n".join(f"Jan  1 00:0{i}:00 h sshd[{i}]: Failed password" for i in range(4)) + "\n")
    logs = sm.parsed_logs(sm.log_line_stream(spark, str(tmp_path), glob="*.log"), reference_year=2024)
    bursts = sm.failure_bursts(logs, "hostname", "timestamp", F.col("message").contains("Failed"))
    out = sm.run_available_now(bursts, name="t-bursts")
    got = sm.latest_rows(spark, out, ["hostname", "window_start"]).agg(F.max("failures")).first()[0]
    assert got == 4
    procs = tp.parse_ps_aux(lines_df(spark, PS.replace("/opt/gone", "/tmp/gone"), "ps_aux.txt"))
    a = det.detect_processes(procs).withColumn("detected_at", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp"))
    assert sm.dedup_anomalies(a.unionByName(a)).count() == 1


def test_flat_file_lines_are_numbered_over_splits(spark, tmp_path):
    """Numbers are places in the file, whatever the splits; long lines, empty lines and files, no last newline."""
    d = tmp_path / "uac-h-linux-20240101000000"
    d.mkdir()
    texts = {"a.log": "".join(f"line {i} {'x' * (i % 90)}\n" for i in range(3000)), "b.log": "one\n\n" + "y" * 20000 + "\nlast",
             "empty.log": "", "c.log": "\n" * 5000}
    for name, text in texts.items():
        (d / name).write_text(text)
    want = sorted((name, i, line) for name, text in texts.items()
                  for i, line in enumerate(text[:-1].split("\n") if text.endswith("\n") else text.split("\n") if text else []))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for size in ("3k", "50k"):
            for k in keys:
                spark.conf.set(k, size)
            lines = arc.read_text_lines(spark, str(d), glob="*.log")
            got = [(r.source_file.rsplit("/", 1)[1], r.line_no, r.line) for r in lines.collect()]
            assert sorted(got) == want
            if size == "3k":
                assert spark.read.text(str(d)).rdd.getNumPartitions() > 20
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
