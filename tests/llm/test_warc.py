"""WARC archives and their index: SQL, round trips, edge cases."""

from __future__ import annotations

import gzip
import hashlib

import duckdb
from pyspark.sql import functions as F

from hostlens.llm import registry, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, key string, digest int"


def _round_trip(df, folder, **more):
    captures = warc.write_archives(df, folder, **more)
    directory = warc.build_index(captures, folder, block_lines=3)
    keys = df.select(warc.url_key(F.col("url")).alias("key"))
    return captures, directory, warc.fetch(warc.lookup(keys, directory))


def test_op7_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.execute(registry.OP7_SQL).fetchall(), key=str)
    assert sorted(map(tuple, registry.op7_warc(spark, SF).collect()), key=str) == want


def test_edge_cases(spark, tmp_path):
    """Null and empty html, null and odd urls, ties, repeated rows, clashing extra columns, hot urls and payloads."""
    big, other = "ü" * 60, "x" * 100
    rows = [(1, "http://a.org/x", big), (2, "http://A.org:8080/x", big), (3, None, big), (4, "no url\r\nWARC-Type: x", None),
            (5, "http://b.c.org/", ""), (6, "http://b.c.org/", "small"), (7, "https://u@b.c.org?q=1", "small"),
            (8, "http://a.org/x", other), (8, "http://a.org/x", other), (None, "http://z.org/", "y" * 99),
            (9, "http://a.org/x", big)] + [(100 + i, "http://hot.org/", "hot " * 40) for i in range(40)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(4)
    captures, directory, records = _round_trip(df, f"file://{tmp_path}", file_bytes=500, files=3)
    got = records.collect()
    assert sorted((r["page_id"] or 0, bytes(r["payload"]) if r["record_type"] == "response" else b"") for r in got) == sorted(
        (i or 0, (h or "").encode() if i not in (2, 3, 9) and not (i or 0) > 100 else b"") for i, _, h in
        rows[:8] + [(8, "", None)] + rows[9:])
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"], r["payload_bytes"]))
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        assert r["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
    assert by[1] == [("response", None, 120)] and by[2] == by[3] == by[9] == [("revisit", 1, 120)]
    assert sorted(by[8]) == [("response", None, 100), ("revisit", 8, 100)]
    assert by[4] == [("response", None, 0)] and by[None] == [("response", None, 99)]
    assert by[100] == [("response", None, 160)] and all(by[100 + i] == [("revisit", 100, 160)] for i in range(1, 40))
    first = captures.orderBy("file", "offset").first()
    with open(first["file"].removeprefix("file://"), "rb") as f:  # members stand alone
        f.seek(first["offset"])
        assert gzip.decompress(f.read(first["length"])).startswith(b"WARC/1.1\r\nWARC-Type: ")
    one = warc.lookup(spark.createDataFrame([("org,c,b)/",), ("org,nowhere)/",), (None,)], "key string"), directory).collect()
    assert sorted(r["page_id"] for r in one) == [5, 6]


def test_empty_table(spark, tmp_path):
    captures, directory, records = _round_trip(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}")
    assert (captures.count(), directory.count(), records.count()) == (0, 0, 0)
