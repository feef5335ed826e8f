"""Scans do only the work that a query asks for: read from the optimized plans, rows checked beside them."""

from __future__ import annotations

from conftest import lines_df

from hostlens.operators import chunks as ch
from hostlens.operators import detectors as det
from hostlens.plans import derived as d
from hostlens.session import ensure_engine_conf
from hostlens.sources import archive as arc
from hostlens.sources import text_parsers as tp

NET = "\n".join([
    "Proto Recv-Q Send-Q Local Foreign State PID/Program",
    "tcp 0 0 0.0.0.0:4444 0.0.0.0:* LISTEN 11/nc",
    "tcp 0 0 10.0.0.5:40000 1.2.3.4:31337 ESTABLISHED -",
    "udp 0 0 10.0.0.5:53 0.0.0.0:* a/b 7/x",
])
BODY = "0|/tmp/a|1|-rwsr-xr-x|0|0|1|1|1|1|1\n0|/opt/.x|2|-rw-r--r--|0|0|1|1|1|1|1"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_netstat_searches_the_slash_token_once(spark):
    conns = tp.parse_netstat(lines_df(spark, NET))
    owned = conns.where("pid is not null").select("line_no", "pid", "program")
    assert [tuple(r) for r in owned.collect()] == [(1, 11, "nc")]
    assert [r.state for r in conns.orderBy("line_no").collect()] == ["LISTEN", "ESTABLISHED", None]
    plan = _plan(owned)
    assert plan.count("regexp_extract(") == 1 and "substring_index(" not in plan  # no address is split for a pid


def test_counts_build_no_anomaly_texts(spark):
    counts = det.severity_counts(det.detect_files(tp.parse_bodyfile(lines_df(spark, BODY))))
    row = counts.collect()[0]
    assert (row.high, row.medium, row.total) == (1, 1, 2)
    plan = _plan(counts)
    assert "lambdafunction(" not in plan and det.T["fs_tmpexec"]["description"] not in plan


def test_groups_are_assigned_without_interpreted_lambdas(spark):
    g = ch._assign_groups(lines_df(spark, "a\nb"), [("all", ch.F.lit(True)), ("b", ch.F.col("line") == "b")])
    assert sorted((r.line, r.group, r.group_rank) for r in g.collect()) == [("a", "all", 0), ("b", "all", 0), ("b", "b", 1)]
    assert "lambdafunction(" not in _plan(g)


def test_one_kind_of_listing_builds_its_own_lines_only(spark):
    events = spark.range(12).selectExpr("id event_id", "timestamp'2024-01-01 10:00:00' ts", "id user_id", "'view' event_type", "1.0D value")
    lines = d.process_lines(events).where(arc.live_kind("source_file") == "ps_ef")
    assert {r.source_file for r in lines.collect()} == {d.PS_FILES[1]}
    assert lines.where("line_no > 0").count() == 4
    # the predicate stands below the node that holds the lines
    assert _plan(lines).index("Generate") < _plan(lines).index("Filter")


def test_long_expressions_stay_below_the_size_the_jvm_compiles(spark):
    ensure_engine_conf(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
