"""YAML records and super-timeline CSV."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hostlens.sources import structured as st


def _files(spark, items):
    rows = [("c1", path, text.encode()) for path, text in items]
    return spark.createDataFrame(rows, "collection_id string, relative_path string, content binary")


def test_yaml_logs_network_raw(spark):
    files = _files(spark, [
        ("c/files/logs/var_log.yaml",
         "output:\n  - message: disk full\n    host: h1\n    pid: 7\n    timestamp: '2024-01-02T03:04:05Z'\n"
         "  - 'Jan  2 03:04:05 h2 cron[1]: run'\n"
         "---\n- msg: list map\n- '2024-01-02 03:04:06 list string'\n---\n'plain doc\n\n2024-01-02 03:04:07 x'\n"),
        ("c/live_response/network/netstat.yaml",
         "output: |\n  Active Internet connections\n  Proto Recv-Q Send-Q Local Foreign State\n"
         "  tcp 0 0 10.0.0.1:22 10.0.0.2:5000 ESTABLISHED\n---\noutput:\n  - proto: udp\n    local: 0.0.0.0\n    local_port: 53\n"),
        ("c/live_response/network/arp.yaml", "output: '? (10.0.0.1) at aa:bb'\n"),
        ("c/live_response/system/uname.yaml", "output:\n  kernel: 6.1\n---\noutput: last doc wins\n"),
    ])
    logs_rec = st.yaml_records(files.where(F.col("relative_path").contains("logs")))
    logs = st.yaml_logs(logs_rec, reference_year=2024).orderBy("line_no").collect()
    got = [(r.log_type, r.message, r.hostname, r.pid, r.timestamp) for r in logs]
    assert got == [
        ("yaml", "disk full", "h1", 7, dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("syslog", "run", "h2", 1, dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("yaml", "list map", None, None, None),
        ("generic", "list string", None, None, dt.datetime(2024, 1, 2, 3, 4, 6)),
        ("unknown", "plain doc", None, None, None),
        ("generic", "x", None, None, dt.datetime(2024, 1, 2, 3, 4, 7)),
    ]
    live = st.yaml_records(files.where(F.col("relative_path").contains("live_response")))
    conns = st.yaml_connections(live).orderBy("line_no").collect()
    assert [(c.protocol, c.local_address, c.local_port, c.remote_port, c.state) for c in conns] == [
        ("tcp", "10.0.0.1", 22, 5000, "ESTABLISHED"), ("udp", "0.0.0.0", 53, 0, "")]
    raw = {r.path: r.content for r in st.yaml_raw_outputs(live).collect()}
    assert raw["c/live_response/system/uname.yaml"] == "last doc wins"
    assert raw["c/live_response/network/arp.yaml#0"] == "? (10.0.0.1) at aa:bb"


def test_l2t_csv(spark, tmp_path):
    p = tmp_path / "host-a.csv"
    p.write_text("date,time,MACB,source,sourcetype,type,desc,filename\n"
                 "01/02/2024,03:04:05,M...,FILE,OS:stat,Modified,File changed,/etc/passwd\n"
                 "13/45/2024,03:04:05,M...,FILE,OS:stat,Modified,bad date,/x\n")
    ev = st.read_l2t_csv(spark, str(p))
    rows = {r.desc: r for r in ev.collect()}
    assert rows["File changed"].timezone == "UTC" and rows["File changed"].user == ""
    assert rows["File changed"].timestamp == dt.datetime(2024, 1, 2, 3, 4, 5) and rows["bad date"].timestamp is None
    tl = st.l2t_timeline(ev).collect()
    assert [(r.collection_id, r.message, r.source_type) for r in tl] == [("host-a", "File changed (/etc/passwd)", "OS:stat")]
