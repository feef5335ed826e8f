"""Numbers within groups over many partitions; bursts by cells; ancestry by pointer doubling."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostlens.operators import enrich, numbering, timeline


def test_one_group_over_many_partitions(spark):
    """A group of most rows lies over several partitions; small and null groups stand beside it."""
    rng = random.Random(1)
    rows = [("hot", i, f"l{i}") for i in range(20_000)] + [(f"g{k}", i, "x") for k in range(30) for i in range(rng.randrange(1, 40))]
    rows += [(None, i, "n") for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, line string").repartition(7)
    got = numbering.numbered(df, ["g"], ["o"], "n", partitions=8)
    assert "Window" not in got.select("line", "n")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    out = got.collect()
    assert len(out) == len(rows)
    assert all(r["n"] == r["o"] + 1 for r in out)
    assert got.columns == ["g", "o", "line", "n"]
    assert numbering.numbered(df.limit(0), ["g"], ["o"]).count() == 0


def test_segments_of_a_large_group(spark):
    df = spark.range(25_000).select(F.lit("c").alias("k"), F.col("id").alias("o"), F.lit(None).cast("string").alias("z")).repartition(5)
    out = timeline.segment_texts(df, ["k"], ["o"], F.concat(F.col("o").cast("string"), F.lit("\n")), totals=(F.count(F.lit(1)).alias("n"),))
    texts = {r["segment"]: (r["n"], r["_text"]) for r in out.collect()}
    assert sorted(texts) == list(range(25)) and {n for n, _ in texts.values()} == {25_000}
    assert "".join(texts[k][1] for k in range(25)) == "".join(f"{i}\n" for i in range(25_000))
    few = timeline.segment_texts(df, ["k"], ["o"], F.col("o").cast("string"), first=3).collect()
    assert [r["_text"] for r in few] == ["012"]


@pytest.mark.parametrize("horizon", [60, 90, 3600, 7])
def test_bursts_by_cells(spark, horizon):
    """Counts over cells and their ends equal plain counting, one address holding most events."""
    rng = random.Random(horizon)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        who = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        at = t0 + timedelta(microseconds=rng.choice([rng.randrange(0, 7200 * 10**6), rng.randrange(0, 7200) * 10**6]))
        rows.append((i, who, at if i % 50 else None, rng.random() < 0.8))
    df = spark.createDataFrame(rows, "event_id bigint, who string, ts timestamp, bad boolean").repartition(4)
    got = enrich.failures_before(df, "who", "ts", F.col("bad"), ~F.col("bad"), horizon).collect()
    want = {}
    for i, who, at, bad in rows:
        if not bad and who is not None and at is not None:
            n = sum(w == who and b and t is not None and timedelta(0) < at - t <= timedelta(seconds=horizon) for _, w, t, b in rows)
            if n >= 3:
                want[i] = n
    assert {r["event_id"]: r["failures"] for r in got} == want and len(got) == len(want)


def test_ancestry(spark):
    """Long chains, several roots, a cycle, processes below it, processes that are their own parents, unknown parents."""
    rows = [("h", "f", k, k, k - 1 if k > 1 else 0) for k in range(1, 300)]  # a chain of 299
    rows += [("h", "f", 1000, 1000, 1002), ("h", "f", 1001, 1001, 1000), ("h", "f", 1002, 1002, 1001), ("h", "f", 1003, 1003, 1001)]
    rows += [("h", "f", 2000, 2000, 2000), ("h", "f", 2001, 2001, 2000), ("h", "f", 2002, 2002, 9999), ("h", "f", 2003, 2003, None)]
    rows += [("h", "g", 1, 7, 2000), ("h", "f", 3000, None, 1), ("i", "f", 1, 5, 4)]
    df = spark.createDataFrame(rows, "collection_id string, source_file string, line_no bigint, pid bigint, ppid bigint").repartition(4)
    out = {(r["collection_id"], r["pid"]): (r["root_pid"], r["depth"], r["path"]) for r in enrich.process_ancestry(df).collect()}
    assert out["h", 299] == (1, 298, list(range(1, 300)))
    assert out["h", 7] == (1, 6, list(range(1, 8)))  # the first listing stands
    for pid in (1000, 1001, 1002, 1003):
        assert out["h", pid] == (None, None, [])
    assert out["h", 2000] == (2000, 0, [2000]) and out["h", 2001] == (2000, 1, [2000, 2001])
    assert out["h", 2002] == (2002, 0, [2002]) and out["h", 2003] == (2003, 0, [2003]) and out["i", 5] == (5, 0, [5])
    assert len(out) == 299 + 4 + 4 + 1
