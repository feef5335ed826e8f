"""Command-level workflows over parsed collections."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from hostlens.operators import retrieval as ret
from hostlens.plans import collection as col
from hostlens.plans import workflows as wf
from test_archive import ROOT, _tar


# a lambda ships to the Python workers by value (a named test function would need the test module there)
_embed = lambda texts: [[float(len(t) % 97), float(t.count("e")), float(t.count("/")), 1.0] for t in texts]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("wf")
    _tar(d / f"{ROOT}.tar.gz")
    # the intended use: parse once, write the tables, run every command on the stored tables
    store = str(d / "tables")
    col.write_tables(col.parse_archives(spark, str(d)), store)
    return col.read_tables(spark, store)


def test_analyze_and_parse(tables):
    out = wf.anomaly_outputs(tables)
    ids = [r.anomaly_id for r in out["anomalies"].collect()]
    assert ids[0] == "net_listen_4444"                       # critical first
    assert "proc_1_deleted_binary" in ids and "proc_4242_deleted_binary" not in ids and "fs_hidden_3" in ids
    c = out["counts"].first()
    assert c.total == len(ids) and c.critical == 1
    assert out["report_rows"].count() > len(ids)
    counts = {r.table: r.rows for r in wf.parse_counts(tables).collect()}
    assert counts["bodyfile"] == 3 and counts["users"] == 2


def test_index_query_timeline_export(spark, tables, tmp_path):
    store_path = str(tmp_path / "store")
    wf.chunk_store(tables, store_path, embed_fn=_embed, dim=4)
    store = spark.read.parquet(store_path)
    kinds = {r.artifact_type for r in store.select("artifact_type").distinct().collect()}
    assert kinds == {"bodyfile", "process", "network", "user", "timeline", "log", "summary"}
    qs = spark.createDataFrame([(ROOT, "q1", 0, "which process listens on 4444?"),
                                (ROOT, "q1", 1, "listening sockets")],
                               "collection_id string, query_id string, variant_no int, text string")
    prompts = wf.query_prompts(store, qs, lambda q: ret.embed_with(q, "text", _embed, 4)).collect()
    assert len(prompts) == 1 and "Question: which process listens on 4444?" in prompts[0].prompt
    assert "--- Source: " in prompts[0].prompt
    view = wf.timeline_view(tables, start="2024-01-05 10:20:00", end="2024-01-05 10:21:00")
    assert sorted(r.message for r in view.where(F.col("collection_id") == ROOT).collect()) == [
        "Failed password for root from 1.2.3.4 port 22 ssh2", "app started"]
    for fmt in ("jsonl", "json", "csv", "markdown"):
        wf.export(tables, fmt, str(tmp_path / fmt))
        assert glob.glob(str(tmp_path / fmt / "collection_id=*" / "*")), fmt
    md = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "markdown" / f"collection_id={ROOT}" / "*.txt"))))
    assert md.startswith("# Forensic export: web-01.example")
