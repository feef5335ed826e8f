"""Detectors and joins on small literal tables."""

from __future__ import annotations

from conftest import lines_df

from pyspark.sql import functions as F

from hostlens.operators import detectors as det
from hostlens.operators import enrich as en
from hostlens.sources import text_parsers as tp

PS = "\n".join([
    "USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND",
    "root 10 0.0 0.1 1 1 ? S 00:00 0:00 /tmp/.x/miner --quiet",
    "bob 11 50.0 0.1 1 1 ? S 00:00 0:00 nc -lvp 4444",
    "bob 12 0.0 0.1 1 1 ? S 00:00 0:00 bash -c echo aGk= | base64 -d | sh",
    "svc 13 0.0 0.1 1 1 ? S 00:00 0:00 /usr/sbin/sshd -D",
])
NET = "\n".join([
    "Proto Recv-Q Send-Q Local Foreign State PID/Program",
    "tcp 0 0 0.0.0.0:4444 0.0.0.0:* LISTEN 11/nc",
    "tcp 0 0 10.0.0.5:40000 1.2.3.4:31337 ESTABLISHED 99/ghost",
])
BODY = "\n".join([
    "0|/usr/bin/sudo|1|-rwsr-xr-x|0|0|1|1|1700000000|1|1",
    "0|/opt/evil|2|-rwsr-xr-x|0|0|1|1|1700000000|1|1",
    "0|/tmp/payload|3|-rwxr-xr-x|0|0|1|1|0|1|1",
    "0|/home/u/.hidden/run|4|-rwxr-xr-x|0|0|1|1|1|1|1",
    "0|/home/u/.ssh/id|5|-rwx------|0|0|1|1|1|1|1",
])
PASSWD = "\n".join(["root:x:0:0::/root:/bin/bash", "toor:x:0:0::/root:/bin/bash", "svc:x:900:900::/:/bin/sh",
                    "nobody:x:65534:1::/:/usr/sbin/nologin"])


def _ids(df):
    return sorted(r.anomaly_id for r in df.collect())


def test_process_rules(spark):
    procs = tp.parse_ps_aux(lines_df(spark, PS, "ps_aux.txt"))
    a = det.detect_processes(procs)
    assert _ids(a) == ["proc_10_suspicious_path", "proc_11_known_suspicious", "proc_12_encoded_cmd"]
    row = a.where(F.col("anomaly_id") == "proc_10_suspicious_path").first()
    assert row.evidence[0].raw_data == "PID: 10, User: root, Command: /tmp/.x/miner --quiet"
    assert row.investigation_steps[0] == "Look at the binary: ls -la /tmp/.x/miner"


def test_network_rules(spark):
    conns = tp.parse_netstat(lines_df(spark, NET, "netstat.txt"))
    a = det.detect_network(conns)
    assert _ids(a) == ["net_40000_31337", "net_listen_4444"]
    d = a.where(F.col("anomaly_id") == "net_40000_31337").first()
    assert d.description == "Connection to port 31337 (Elite/Backdoor)"
    assert d.evidence[0].raw_data == "tcp 10.0.0.5:40000 -> 1.2.3.4:31337"


def test_file_and_user_rules(spark):
    bf = tp.parse_bodyfile(lines_df(spark, BODY, "bodyfile.txt"))
    assert _ids(det.detect_files(bf)) == ["fs_hidden_4", "fs_suid_2", "fs_tmpexec_3"]
    users = tp.parse_passwd(lines_df(spark, PASSWD, "passwd"))
    assert _ids(det.detect_users(users)) == ["user_svc_system_shell", "user_toor_uid0"]


def test_rank_threshold_and_counts(spark):
    procs = tp.parse_ps_aux(lines_df(spark, PS, "ps_aux.txt"))
    users = tp.parse_passwd(lines_df(spark, PASSWD, "passwd"))
    allx = det.detect_all(processes=procs, users=users, threshold="low")
    ranked = [r.anomaly_id for r in det.rank_anomalies(allx).collect()]
    assert ranked == ["proc_11_known_suspicious", "user_toor_uid0", "proc_12_encoded_cmd",
                      "proc_10_suspicious_path", "user_svc_system_shell"]
    high = det.detect_all(processes=procs, users=users, threshold="high")
    assert high.count() == 4
    c = det.severity_counts(allx).first()
    assert (c.critical, c.high, c.medium, c.low, c.info, c.total) == (2, 2, 1, 0, 0, 5)


def test_joins(spark):
    procs = tp.parse_ps_aux(lines_df(spark, PS, "ps_aux.txt"))
    conns = tp.parse_netstat(lines_df(spark, NET, "netstat.txt"))
    bf = tp.parse_bodyfile(lines_df(spark, BODY + "\n0|/usr/sbin/sshd|9|-rwxr-xr-x|0|0|1|1|1|1|1", "bodyfile.txt"))
    b = {r.pid: (r.binary_path, r.binary_exists) for r in en.with_binary_info(procs, bf).collect()}
    assert b == {10: ("/tmp/.x/miner", False), 11: (None, None), 12: (None, None), 13: ("/usr/sbin/sshd", True)}
    hidden = en.detect_hidden_processes(conns, procs)
    assert _ids(hidden) == ["net_hidden_99"]
    pc = en.process_connections(procs, conns).where(F.col("pid") == 11).collect()
    assert [(r.pid, r.local_port) for r in pc] == [(11, 4444)]


def test_range_join_and_bursts(spark):
    ev = spark.createDataFrame([
        (1, "2024-01-01 00:00:00", 7, "error"), (2, "2024-01-01 00:04:59", 7, "view"),
        (3, "2024-01-01 00:05:01", 7, "view"), (4, "2024-01-01 00:00:30", 8, "view"),
        (5, "2024-01-01 10:00:00", 7, "error"), (6, "2024-01-01 20:00:00", 7, "error"),
        (7, "2024-01-02 00:00:00", 7, "signup"), (8, "2024-01-02 00:00:01", 7, "signup"),
    ], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    around = en.events_around(ev.where(F.col("event_type") == "error"), ev, "user_id", "ts", 300, "event_id", "event_id")
    assert sorted((r.pivot_id, r.event_id) for r in around.collect()) == [(1, 2)]
    bursts = en.failures_before(ev, "user_id", "ts", F.col("event_type") == "error", F.col("event_type") == "signup")
    assert sorted((r.event_id, r.failures) for r in bursts.collect()) == [(7, 3)]
