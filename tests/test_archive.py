"""Archive scan -> categorise -> parse, end to end on built tar.gz / zip collections."""

from __future__ import annotations

import datetime as dt
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from hostlens.plans import collection as col
from hostlens.sources import archive as arc

ROOT = "uac-web-01-linux-20240105103000"
FILES = {
    f"{ROOT}/uac.log": "Start\nHostname: web-01.example\nOS: linux\nOS: Ubuntu 22.04\n",
    f"{ROOT}/bodyfile/bodyfile.txt": "\n".join([
        "0|/usr/bin/sudo|1|-rwsr-xr-x|0|0|10|1704400000|1704400100|1704400100|1704400100",
        "0|/tmp/.x/miner|2|-rwxr-xr-x|0|0|20|1704400000|1704400200|1704400200|1704400000",
        "0|/opt/.hidden/run|3|-rwxr-xr-x|0|0|30|0|0|0|0",
    ]) + "\n",
    f"{ROOT}/live_response/process/ps_auxwww.txt": "\n".join([
        "USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND",
        "root 1 0.0 0.1 100 10 ? Ss 10:00 0:01 /sbin/init",
        "www 4242 12.5 6.0 900 90 ? S 10:01 0:09 /tmp/.x/miner --pool x",
    ]) + "\n",
    f"{ROOT}/live_response/network/netstat_-tunap.txt": "\n".join([
        "Proto Recv-Q Send-Q Local Address Foreign Address State PID/Program name",
        "tcp 0 0 0.0.0.0:4444 0.0.0.0:* LISTEN 4242/miner",
    ]) + "\n",
    f"{ROOT}/live_response/user/etc_passwd.txt": "root:x:0:0:root:/root:/bin/bash\nsvc:x:900:900::/srv:/bin/sh\n",
    f"{ROOT}/live_response/system/uname_-a.txt": "Linux web-01 6.1.0 x86_64\n",
    f"{ROOT}/live_response/process/ps.yaml": (
        "output: |\n  USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND\n"
        "  bob x9 1.0 1.0 1 1 ? S 10:00 0:00 /usr/bin/vim notes\n"
        "---\noutput:\n  - pid: 77\n    cmd: /usr/bin/python3 app.py\n    uid: app\n    '%cpu': 2.5\n"),
    f"{ROOT}/hash_executables/hash_executables.md5": "d41d8cd98f00b204e9800998ecf8427e  /usr/bin/sudo\n",
    f"{ROOT}/[root]/var/log/auth.log": "\n".join([
        "Jan  5 10:20:00 web-01 sshd[900]: Failed password for root from 1.2.3.4 port 22 ssh2",
        "2024-01-05T10:21:00Z app started",
        "",
        "no time here",
    ]) + "\n",
    f"{ROOT}/[root]/var/log/old.log.gz": "binary?",
    "../escape.txt": "must be skipped",
}


def _tar(path):
    with tarfile.open(path, "w:gz") as tf:
        info = tarfile.TarInfo(ROOT)
        info.type = tarfile.DIRTYPE
        tf.addfile(info)
        for name, text in FILES.items():
            data = text.encode()
            ti = tarfile.TarInfo(name)
            ti.size = len(data)
            tf.addfile(ti, io.BytesIO(data))


def _zip(path):
    with zipfile.ZipFile(path, "w") as zf:
        zf.writestr(ROOT + "/", b"")
        for name, text in FILES.items():
            zf.writestr(name, text)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("archives")
    _tar(d / f"{ROOT}.tar.gz")
    _zip(d / "second-copy.zip")
    return col.parse_archives(spark, str(d))


def test_members_and_categories(spark, tables):
    files = tables["artifact_files"]
    cats = {(r.collection_id, r.relative_path.split("/", 1)[-1]): r.category for r in files.collect()}
    key = (ROOT, "live_response/process/ps_auxwww.txt")
    assert cats[key] == "live_response"
    assert cats[(ROOT, "bodyfile/bodyfile.txt")] == "bodyfile"
    assert cats[(ROOT, "hash_executables/hash_executables.md5")] == "hash"
    assert cats[(ROOT, "[root]/var/log/auth.log")] == "logs"
    assert not any("escape" in p for _, p in cats)
    tot = {r.collection_id: (r.total_files, r.total_size) for r in arc.inventory_totals(files.withColumn(
        "size", F.col("size"))).collect()}
    n_files = len([k for k in FILES if not k.startswith("..")])
    assert tot[ROOT][0] == n_files and tot["second-copy"][0] == n_files


def test_artifact_paths(tables):
    rows = arc.artifact_paths(tables["artifact_files"]).where(F.col("collection_id") == ROOT).collect()
    by_cat = {}
    for r in rows:
        by_cat.setdefault(r.category, []).append(r.relative_path.split("/", 1)[-1])
    assert by_cat["bodyfile"] == ["bodyfile/bodyfile.txt"]
    assert by_cat["logs"] == sorted(by_cat["logs"]) and "[root]/var/log/auth.log" in by_cat["logs"]


def test_collection_metadata(tables):
    meta = {r.collection_id: r for r in tables["collections"].collect()}
    m = meta[ROOT]
    assert (m.hostname, m.os_type) == ("web-01.example", "Ubuntu 22.04")
    assert m.collection_time == dt.datetime(2024, 1, 5, 10, 30, 0)


def test_parsed_tables(tables):
    bf = tables["bodyfile"].where(F.col("collection_id") == ROOT)
    assert sorted(r.name for r in bf.collect()) == ["/opt/.hidden/run", "/tmp/.x/miner", "/usr/bin/sudo"]
    procs = {r.pid: r for r in tables["processes"].where(F.col("collection_id") == ROOT).collect()}
    assert set(procs) == {1, 4242, 0, 77}
    assert procs[0].command == "/usr/bin/vim notes"   # YAML text output keeps a bad PID as 0
    assert (procs[77].user, procs[77].cpu, procs[77].command) == ("app", 2.5, "/usr/bin/python3 app.py")
    conns = tables["connections"].where(F.col("collection_id") == ROOT).collect()
    assert [(c.local_port, c.pid, c.program) for c in conns] == [(4444, 4242, "miner")]
    users = sorted(r.username for r in tables["users"].where(F.col("collection_id") == ROOT).collect())
    assert users == ["root", "svc"]
    hashes = tables["hashes"].where(F.col("collection_id") == ROOT).collect()
    assert [(h.filepath, h.md5) for h in hashes] == [("/usr/bin/sudo", "d41d8cd98f00b204e9800998ecf8427e")]
    raw = {r.path.split("/", 1)[-1]: r.content for r in tables["raw_outputs"].where(F.col("collection_id") == ROOT).collect()}
    assert raw["live_response/system/uname_-a.txt"].startswith("Linux web-01")


def test_logs_and_timeline(tables):
    mine = tables["logs"].where(F.col("collection_id") == ROOT)
    # uac.log matches the '.log' marker, so it is a log file as well
    assert mine.where(F.col("source_file").endswith("uac.log")).count() == 4
    logs = mine.where(F.col("source_file").endswith("auth.log")).orderBy("line_no").collect()
    assert [(r.log_type, r.message) for r in logs] == [
        ("syslog", "Failed password for root from 1.2.3.4 port 22 ssh2"), ("generic", "app started"),
        ("unknown", "no time here")]
    assert logs[0].timestamp == dt.datetime(2024, 1, 5, 10, 20, 0)   # year from the collection time
    tl = tables["timeline"].where(F.col("collection_id") == ROOT).collect()
    descs = sorted((r.timestamp_desc, r.artifact_path) for r in tl)
    assert ("File Created", "/tmp/.x/miner") in descs and ("File Modified", "/usr/bin/sudo") in descs
    assert sum(1 for d in descs if d[0] == "Log Entry" and d[1].endswith("auth.log")) == 2
    assert not any(d == ("File Created", "/usr/bin/sudo") for d in descs)


def test_write_and_read_tables(spark, tables, tmp_path):
    out = str(tmp_path / "store")
    col.write_tables({k: tables[k] for k in ("bodyfile", "processes")}, out)
    back = col.read_tables(spark, out, ["bodyfile", "processes"])
    assert back["bodyfile"].where(F.col("collection_id") == ROOT).count() == 3
