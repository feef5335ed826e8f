"""Streaming forms equal batch; sinks write readable outputs."""

from __future__ import annotations

import glob
import json

from conftest import lines_df
from pyspark.sql import functions as F

from hostlens.operators import detectors as det
from hostlens.operators import timeline as tl
from hostlens.sinks import writers as w
from hostlens.sources import text_parsers as tp
from hostlens.streaming import streams as sm

LOG = "\n".join(["Jan  2 03:04:05 h a[1]: x", "Jan  2 03:59:59 h a[2]: y", "Jan  2 05:00:00 h a[3]: z",
                 "no time"])


def test_stream_hourly_equals_batch(spark, tmp_path):
    d = tmp_path / "c1"
    d.mkdir()
    (d / "auth.log").write_text(LOG + "\n")
    stream = sm.parsed_logs(sm.log_line_stream(spark, str(tmp_path), glob="*.log"), reference_year=2024)
    out = sm.run_available_now(sm.hourly_counts(stream), name="t-hourly")
    got = {(r.collection_id, str(r.window_start)): r.event_count
           for r in sm.latest_rows(spark, out, ["collection_id", "window_start"]).collect()}
    batch = tp.parse_logs(lines_df(spark, LOG, "auth.log"), reference_year=2024)
    expect = {("c1", str(r.h)): r.n for r in batch.where(F.col("timestamp").isNotNull()).groupBy(
        F.date_trunc("hour", "timestamp").alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == expect


def test_sinks(spark, tmp_path):
    logs = tp.parse_logs(lines_df(spark, LOG, "/var/log/auth.log"), reference_year=2024)
    t = tl.merge_timeline(tl.log_events(logs))
    w.write_timesketch_jsonl(t, str(tmp_path / "ts"))
    recs = [json.loads(x) for f in glob.glob(str(tmp_path / "ts" / "*" / "*.txt")) for x in open(f)]
    assert sorted(r["datetime"] for r in recs) == ["2024-01-02T03:04:05", "2024-01-02T03:59:59", "2024-01-02T05:00:00"]
    assert recs[0]["data_type"] == "uac:log"
    body = tp.parse_bodyfile(lines_df(spark, "0|/usr/bin/x|1|-rwsr-xr-x|0|0|1|1|1700000000|1|1", "bodyfile"))
    w.write_bodyfile_csv(body, str(tmp_path / "bf"))
    text = open(glob.glob(str(tmp_path / "bf" / "*" / "*.csv"))[0]).read()
    assert "mtime_iso" in text and "2023-11-14T22:13:20" in text
    a = det.detect_files(body)
    rows = w.anomaly_report_rows(a, det.severity_counts(a))
    w.write_report(rows, str(tmp_path / "report"))
    md = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "report" / "*" / "*.txt"))))
    assert md.startswith("# Anomaly Detection Report")
    assert md.index("## 🟠 High Severity Anomalies") < md.index("### 🟠 Non-standard SUID binary: x")
    assert "| 🟠 High | 1 |" in md
