"""Remaining sinks, embeddings and store helpers."""

from __future__ import annotations

import csv
import glob
import json

from conftest import lines_df
from pyspark.sql import functions as F

from hostlens.operators import chunks as ch
from hostlens.operators import detectors as det
from hostlens.operators import retrieval as ret
from hostlens.sinks import writers as w
from hostlens.sources import text_parsers as tp

PS = "USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND\nroot 7 0 0 1 1 ? S 0 0 nc -l -p 4444"


def _chunks(spark):
    procs = tp.parse_ps_aux(lines_df(spark, PS, "ps_aux.txt"))
    return ch.process_chunks(procs), procs


def test_chunk_jsonl_and_markdown(spark, tmp_path):
    chunks, _ = _chunks(spark)
    w.write_chunks_jsonl(chunks, str(tmp_path / "chunks"))
    recs = [json.loads(x) for f in glob.glob(str(tmp_path / "chunks" / "*.json")) for x in open(f)]
    assert {r["metadata"]["group"] for r in recs} == {"all", "root"}
    assert all(set(r) >= {"chunk_id", "content", "relevance_tags", "artifact_type"} for r in recs)
    hosts = spark.createDataFrame([("c1", "h1")], "collection_id string, hostname string")
    md = [r.text for r in w.markdown_export(chunks, hosts, n=1).orderBy("seq").collect()]
    assert md[0] == "# Forensic export: h1\n\n**Source:** c1\n\n" and md[1].startswith("## process — ps_output\n\n# Running Processes: All")
    assert len(md) == 2


def test_anomaly_csv_and_rows(spark, tmp_path):
    _, procs = _chunks(spark)
    a = det.detect_processes(procs)
    w.write_anomalies_csv(a, str(tmp_path / "anom"))
    rows = [r for f in glob.glob(str(tmp_path / "anom" / "*" / "*.csv")) for r in csv.DictReader(open(f))]
    assert [(r["id"], r["severity"], r["artifact"]) for r in rows] == [("proc_7_known_suspicious", "critical", "process_list")]
    flat = det.anomaly_rows(a).first()
    assert flat.evidence_count == 0 and flat.type == "suspicious_process"
    assert det.severity_subset(a, "high").count() == 0
    sample = w.sample_rows(procs, ["line_no"], n=1).collect()
    assert [r.pid for r in sample] == [7]


def test_embeddings_and_filters(spark, tmp_path):
    docs = spark.createDataFrame([("c1", 1, "ssh root login failed", ["lateral_movement"]),
                                  ("c1", 2, "cron job wget payload", ["persistence", "exfiltration"]),
                                  ("c2", 3, "ssh key added", ["lateral_movement"])],
                                 "collection_id string, id long, text string, tags array<string>")
    emb, _ = ret.hashing_embeddings(docs, "text", num_features=64)
    v = emb.select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("n2")).collect()
    assert all(abs(r.n2 - 1.0) < 1e-9 for r in v)
    q = emb.where(F.col("id") == 1).select("collection_id", F.lit("q").alias("qid"), "embedding")
    hits = ret.knn(emb, q, "collection_id", k=2, id_col="id", query_cols=["collection_id", "qid"]).orderBy("rank")
    assert [r.id for r in hits.collect()] == [1, 2]
    assert [r.id for r in ret.filter_tags(docs, ["persistence", "x"]).collect()] == [2]
    assert sorted(r.id for r in ret.filter_tags(docs, ["exfiltration", "lateral_movement"], mode="any").collect()) == [1, 2, 3]
    assert [r.id for r in ret.filter_metadata(docs, collection_id="c2").collect()] == [3]
    custom = ret.embed_with(docs.select("collection_id", "id", "text"), "text", lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert [list(r.embedding) for r in custom.orderBy("id").collect()][0] == [21.0, 1.0]
    store = str(tmp_path / "store")
    ret.write_store(emb.drop("tags"), store)
    assert ret.store_count(spark, store) == 3
    ret.clear_store(spark, store, emb.drop("tags").schema)
    assert ret.store_count(spark, store) == 0
