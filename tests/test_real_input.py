"""Input as it comes: bad bytes, damaged archives, equal names, no collection folder, long members, folders of parts."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from hostlens.operators import detectors as det
from hostlens.plans import catalog
from hostlens.plans import collection as col
from hostlens.sinks import writers as w
from hostlens.sources import archive as arc
from hostlens.streaming import streams as sm
from conftest import lines_df


def _tar(path, members, keep=None):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as tf:
        for name, data in members.items():
            ti = tarfile.TarInfo(name)
            ti.size = len(data)
            tf.addfile(ti, io.BytesIO(data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(buf.getvalue()[:keep])


PS = b"USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND\nroot 1 0.0 0.1 100 10 ? Ss 10:00 0:01 /sbin/init\n"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet")
    log = b"2024-01-05T10:21:00Z ok \xff\xfebad\n2024-01-05T10:22:00Z genuine \xef\xbf\xbd mark\n"
    _tar(root / "a" / "collect.tar", {"live_response/process/ps_aux.txt": PS, "[root]/var/log/app.log": log})
    _tar(root / "b" / "collect.tar", {"live_response/process/ps_aux.txt": PS + PS.split(b"\n")[1] + b"\n",
                                      "hash_executables/hashes.yaml": b"d41d8cd98f00b204e9800998ecf8427e  /bin/x\n"})
    _tar(root / "cut.tar", {"live_response/process/ps_aux.txt": PS, "[root]/var/log/big.log": b"x" * 5000}, keep=2200)
    (root / "broken.tar.gz").write_bytes(b"this is no archive")
    with zipfile.ZipFile(root / "z.zip", "w") as zf:
        zf.writestr("[root]/var/log/z.log", "line one\nline two\n")
    return col.load_archives(spark, str(root), str(tmp_path_factory.mktemp("out")))


def test_every_input_has_a_collection_and_its_members(tables):
    ids = {r["collection_id"] for r in tables["collections"].collect()}
    assert {"a__collect", "b__collect", "cut", "z"} <= ids
    rows = {(r["collection_id"], r["pid"]): r["count"] for r in tables["processes"].groupBy("collection_id", "pid").count().collect()}
    assert rows == {("a__collect", 1): 1, ("b__collect", 1): 2, ("cut", 1): 1}  # hosts of one file name stay apart


def test_bad_bytes_are_dropped_and_real_marks_stay(tables):
    logs = [r["message"] for r in tables["logs"].where("collection_id = 'a__collect'").orderBy("line_no").collect()]
    assert logs == ["ok bad", "genuine � mark"]


def test_damaged_archives_keep_what_came_before(tables):
    errors = {r["collection_id"]: r["error"] for r in tables["errors"].collect()}
    assert set(errors) == {"cut", "broken"}
    assert tables["artifact_files"].where("collection_id = 'cut'").count() >= 1


def test_hash_lists_of_any_suffix(tables):
    assert [(r["filepath"], r["md5"][:4]) for r in tables["hashes"].collect()] == [("/bin/x", "d41d")]


def test_long_members_come_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arc, "PART_BYTES", 50)
    text = "".join(f"line {i} {'y' * (i % 30)}\n" for i in range(60)) + "z" * 200
    _tar(tmp_path / "m.tar", {"[root]/var/log/long.log": text.encode(), "e.txt": b""})
    members = list(arc._unpack("m.tar", (tmp_path / "m.tar").read_bytes(), "m"))
    parts = [m for m in members if m[2].endswith("long.log")]
    assert len(parts) > 5 and b"".join(m[5] for m in parts) == text.encode()
    df = spark.createDataFrame(members, arc.MEMBER_SCHEMA)
    files = arc.catalog_members(df)
    lines = arc.member_lines(files).where(F.col("source_file").endswith("long.log")).orderBy("line_no").collect()
    assert [r["line"] for r in lines] == text.split("\n") and [r["line_no"] for r in lines] == list(range(61))
    assert arc.inventory_totals(files).first()["total_files"] == 2


def test_a_load_unpacks_once(tables):
    plan = "".join(t._jdf.queryExecution().toString() for t in tables.values())
    assert "MapInPandas" not in plan  # the tables read what was written


def test_structured_document(tables):
    doc = {r["collection_id"]: json.loads(r["json"]) for r in w.structured_data(tables).collect()}
    a, z = doc["a__collect"], doc["z"]
    assert a["summary"]["processes"] == 1 and a["summary"]["log_entries"] == 2 and len(a["summary"]) == 9
    assert z["processes"] == [] and z["network"] == [] and z["metadata"]["hostname"] is None
    assert set(a["processes"][0]) == {"pid", "ppid", "user", "command", "cpu", "mem"}
    assert doc["b__collect"]["summary"]["hash_entries"] == 1


def test_directory_without_collection_folder(spark, tmp_path):
    (tmp_path / "live_response" / "process").mkdir(parents=True)
    (tmp_path / "live_response" / "process" / "ps_aux.txt").write_bytes(PS)
    t = col.parse_directory(spark, str(tmp_path), "mine")
    assert [r["collection_id"] for r in t["collections"].collect()] == ["mine"]
    assert t["processes"].count() == 1


def test_user_detector_runs(spark):
    def mine(tables):
        return det.detect_processes(tables["processes"].withColumn("command", F.lit("/tmp/x")))

    pr = spark.createDataFrame([("c", "f", 1, 5, "u", "/bin/ok")], "collection_id string, source_file string, line_no bigint, pid bigint, user string, command string")
    before = det.detect_all(processes=pr).count()
    det.register_detector("mine", mine)
    try:
        assert det.detect_all(processes=pr).count() == before + 1
    finally:
        det.register_detector("mine", None)
    assert det.detect_all(processes=pr).count() == before


def test_stream_reads_a_table_kept_as_a_folder(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(src).repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    whole = {tuple(r) for r in catalog.QUERIES["stream_hourly"](spark, "/root/testdata/sf0.001").collect()}
    parts = {tuple(r) for r in catalog.QUERIES["stream_hourly"](spark, str(tmp_path)).collect()}
    assert whole == parts and whole


def test_detectors_and_dedup_on_a_stream(spark, tmp_path):
    """STR-3, STR-4: the same detector on streaming rows, repeats dropped across micro-batches."""
    schema = "collection_id string, source_file string, line_no bigint, pid bigint, user string, command string, seen timestamp"
    for k in range(2):
        spark.createDataFrame([("c", "f", 1, 9, "u", "/tmp/evil")], "collection_id string, source_file string, line_no bigint, pid bigint, "
                              "user string, command string").withColumn("seen", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.mode(
            "append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = det.detect_processes(stream).withColumn("detected_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    out = sm.dedup_anomalies(found).select("collection_id", "anomaly_id")
    q = (out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_iocs_need_whole_runs(spark):
    from hostlens.operators import ioc

    text = "999.1.1.1 10.0.0.1, v1.2.3.4.5 1.2.3.4. " + "a" * 50 + " " + "b" * 32 + " x" + "c" * 32
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    got = sorted((r["kind"], r["value"]) for r in ioc.extract_iocs(df, "text", "id").collect())
    assert got == [("ipv4", "1.2.3.4"), ("ipv4", "10.0.0.1"), ("md5", "b" * 32)]


def test_segments_hold_every_row(spark):
    from hostlens.operators import timeline as tl

    rows = lines_df(spark, "\n".join(f"2024-01-01T10:00:{i % 60:02d}Z m{i}" for i in range(25)))
    from hostlens.sources import text_parsers as tp

    logs = tp.parse_logs(rows, reference_year=2024)
    blocks = tl.hourly_buckets(tl.log_events(logs), rows_per_segment=10).orderBy("segment").collect()
    assert [b["segment"] for b in blocks] == [0, 1, 2] and {b["event_count"] for b in blocks} == {25}
    assert sum(b["content"].count("[log]") for b in blocks) == 25
    files = tl.logs_by_file(logs, rows_per_segment=10).collect()
    assert sum(f["content"].count("m") >= 1 for f in files) == 3


def test_incident_prompts(spark):
    from hostlens.operators import prompts as pr

    hits = spark.createDataFrame([("c", 1, 0.9, "text one", "s", "log"), ("d", 1, 0.5, "other", "s", "log")],
                                 "collection_id string, rank int, score double, content string, source string, kind string")
    pr_rows = spark.createDataFrame([("c", "f", 1, 5, "u", "/tmp/x | base64 -d")], "collection_id string, source_file string, line_no bigint, "
                                    "pid bigint, user string, command string")
    got = {r["collection_id"]: r["prompt"] for r in pr.incident_prompts(
        hits, det.detect_processes(pr_rows), "content", "source", "kind", ["rank"]).collect()}
    assert "- [high] Process with potential encoded" in got["c"] and "text one" in got["c"] and "none found" in got["d"]
    assert len(pr.TEMPLATES) == 9


def test_hits_join_on_collection_and_chunk(spark):
    """Equal chunks of several hosts do not multiply hits."""
    from hostlens.plans import workflows as wf

    store = spark.createDataFrame([(f"h{i}", "log_1_0", "same text", "s", "log", [1.0, 0.0]) for i in range(5)],
                                  "collection_id string, chunk_id string, content string, source string, artifact_type string, embedding array<double>")
    qs = spark.createDataFrame([("h1", 1, 0, "q?")], "collection_id string, query_id int, variant_no int, text string")
    out = wf.query_prompts(store, qs, lambda q: q.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))).collect()
    assert len(out) == 1 and out[0]["prompt"].count("same text") == 1


def test_login_bursts_are_anomalies(spark):
    from hostlens.operators import enrich as en
    from hostlens.sources import text_parsers as tp

    text = "\n".join([f"Jan  5 10:0{i}:00 h sshd[9]: Failed password for root from {a} port 1 ssh2" for a, k in
                      (("1.2.3.4", 3), ("5.6.7.8", 2)) for i in range(k)]
                     + [f"Jan  5 11:00:00 h sshd[9]: Accepted password for root from {a} port 1 ssh2" for a in ("1.2.3.4", "5.6.7.8", "9.9.9.9")])
    found = en.detect_login_bursts(tp.parse_logs(lines_df(spark, text, "auth.log"), reference_year=2024)).collect()
    assert [(r["anomaly_type"], r["description"]) for r in found] == [("unauthorized_access", "3 failed logins from 1.2.3.4 before this one")]
    assert det.detect_all(processes=None, connections=None, extra=[en.detect_login_bursts(
        tp.parse_logs(lines_df(spark, text, "auth.log"), reference_year=2024))]).count() == 1


def test_scores_join_on_the_entity(spark):
    from hostlens.operators import enrich as en

    pr = spark.createDataFrame([("c", "f", 1, 5, "u", "/tmp/x"), ("c", "f", 2, 6, "v", "/bin/ok")], "collection_id string, source_file string, "
                               "line_no bigint, pid bigint, user string, command string")
    got = {r["user"]: (r["anomaly_score"], r["anomaly_flags"]) for r in en.anomaly_scores(pr, det.detect_processes(pr), "user", "username").collect()}
    assert got == {"u": (0.8, ["suspicious_process"]), "v": (None, None)}
