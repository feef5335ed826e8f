"""Chunk producers, retrieval, context packing, prompts and sections."""

from __future__ import annotations

from conftest import lines_df
from pyspark.sql import functions as F

from hostlens.operators import chunks as ch
from hostlens.operators import ioc
from hostlens.operators import prompts as pr
from hostlens.operators import retrieval as ret
from hostlens.sources import text_parsers as tp


def test_knn_scoped_and_pack(spark):
    corpus = spark.createDataFrame([
        ("a", 1, [0.0, 0.0], "x" * 40), ("a", 2, [1.0, 0.0], "y" * 8000), ("a", 3, [0.1, 0.0], "z" * 40),
        ("b", 4, [0.0, 0.0], "w" * 40),
    ], "scope string, id long, embedding array<double>, text string")
    q = spark.createDataFrame([("a", "q1", [0.0, 0.0])], "scope string, qid string, embedding array<double>")
    hits = ret.knn(corpus, q, "scope", k=3, id_col="id", query_cols=["scope", "qid"])
    got = [(r.id, round(r.distance, 6), round(r.score, 4)) for r in hits.orderBy("rank").collect()]
    assert got == [(1, 0.0, 1.0), (3, 0.01, 0.99), (2, 1.0, 0.0)]
    joined = hits.join(corpus.select("id", "text", F.col("scope").alias("src")), "id").withColumn("kind", F.lit("doc"))
    packed = ret.pack_context(joined, ["qid"], "text", "src", "kind", ["rank"], budget=100).first()
    assert packed.n_used == 2 and packed.tokens_used == 20       # third hit (2000 tokens) overflows
    assert packed.context.startswith("--- Source: a (doc) [relevance: 1.00] ---\n" + "x" * 40 + "\n")


def test_dedup_first_hit_wins(spark):
    hits = spark.createDataFrame([("q", 0, 1, "same"), ("q", 0, 2, "other"), ("q", 1, 1, "same")],
                                 "qid string, variant int, rank int, text string")
    kept = ret.dedup_hits(hits, ["qid"], "text", ["variant", "rank"]).collect()
    assert sorted((r.variant, r.rank) for r in kept) == [(0, 1), (0, 2)]


def test_chunk_producers(spark):
    ps = "\n".join(["USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND",
                    "root 1 20.0 6.0 1 1 ? S 0 0 /sbin/init", "bob 2 0.0 0.0 1 1 ? S 0 0 sshd: bob"])
    procs = tp.parse_ps_aux(lines_df(spark, ps, "ps_aux.txt"))
    c = ch.process_chunks(procs).orderBy("group_rank").collect()
    assert [r.metadata["group"] for r in c] == ["all", "root", "high_cpu", "high_mem"]
    assert c[0].content == ("# Running Processes: All\n\nPID: 1, User: root, CPU: 20.0%, MEM: 6.0%\nCommand: /sbin/init"
                            "\n\nPID: 2, User: bob\nCommand: sshd: bob\n\n")
    assert "lateral_movement" in c[0].tags and c[0].tags[-2:] == ["process", "all"]
    assert c[0].chunk_id.startswith("proc_all_") and c[0].chunk_id.endswith("_0")
    users = tp.parse_passwd(lines_df(spark, "root:x:0:0::/root:/bin/bash\nsvc:x:5:5::/s:/bin/false", "passwd"))
    u = ch.user_chunks(users).first()
    assert u.content.startswith("# User Accounts\n\n## Regular Users\n\n## System Users with Valid Shells\n- root")
    assert u.content.endswith("logins, passwd") and u.metadata["user_count"] == "2"


def test_iocs(spark):
    df = spark.createDataFrame([(1, "mail bob@x.example.com from 10.0.0.1, hash " + "ab" * 16 + " /tmp/x.sh")],
                               "id long, t string")
    got = sorted((r.kind, r.value) for r in ioc.extract_iocs(df, "t", "id").collect())
    assert got == [("email", "bob@x.example.com"), ("ipv4", "10.0.0.1"), ("md5", "ab" * 16), ("path", "/tmp/x.sh")]


def test_sections_prompts_followups(spark):
    ans = "# Report\n## Executive Summary\nAll good.\n\n## Immediate Actions\n1. Isolate\n2) Patch\n- Rotate\n# End"
    df = spark.createDataFrame([(ans, "why ssh?")], "a string, q string")
    r = df.select(pr.extract_section("a", "Executive Summary").alias("s"),
                  pr.action_items(pr.extract_section("a", "Immediate")).alias("acts"),
                  pr.followups("q").alias("f"),
                  pr.fill_template("Q: {query} C: {context} U: {unknown}", query="q", context=F.lit("ctx")).alias("p")
                  ).first()
    assert r.s == "All good."
    assert list(r.acts) == ["Isolate", "Patch", "Rotate"]
    assert r.f[0] == "Which SSH logins failed, from where and for whom?"
    assert r.p == "Q: why ssh? C: ctx U: {unknown}"


def test_approx_knn_agrees_on_clear_neighbours(spark):
    import random
    rng = random.Random(5)
    rows = [("s", i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    corpus = spark.createDataFrame(rows, "scope string, id long, embedding array<double>")
    q = spark.createDataFrame([("s", "q", rows[17][2])], "scope string, query_id string, embedding array<double>")
    exact = ret.knn(corpus, q, "scope", k=3, id_col="id", query_cols=["scope", "query_id"])
    approx = ret.approx_knn(corpus, q, "scope", k=3, id_col="id", bucket_length=4.0, num_tables=6, max_distance=3.0)
    e = [r.id for r in exact.orderBy("rank").collect()]
    a = [r.id for r in approx.orderBy("rank").collect()]
    assert a[0] == e[0] == 17 and set(a) <= set(r[1] for r in rows)


def test_search_of_all_vectors_crosses_labels(spark, tmp_path):
    """Queries are the rows with ids divisible by 100; a near neighbour under another label is found."""
    from hostlens.plans import catalog

    rows = [(100, "a", [0.0, 0.0]), (1, "b", [0.1, 0.0]), (2, "a", [3.0, 0.0]), (200, "b", [9.0, 9.0])]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in catalog.QUERIES["vector_topk_all"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {100: [100, 1, 2, 200], 200: [200, 2, 1, 100]}
