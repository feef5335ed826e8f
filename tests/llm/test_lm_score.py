"""Cross-entropy difference against plain counting and SQL."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from hostlens.llm import lm_score, registry

SF = "/root/testdata/sf0.001"
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def model(docs, targets, word_share, pair_share, smoothing):
    rows = [(d, (t or "").encode().translate(LOW).split()) for d, t in docs]
    own = [d is not None and d in targets for d, _ in rows]
    one = [Counter(), Counter()]
    for (_, w), o in zip(rows, own):
        for x in (0, 1) if o else (0,):
            one[x].update(w)
    n = [sum(c.values()) for c in one]
    vocabulary = {w for w, c in one[0].items() if c >= word_share * n[0]}
    rows = [(d, [x if x in vocabulary else None for x in w]) for d, w in rows]
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for (_, w), o in zip(rows, own):
        for x in (0, 1) if o else (0,):
            one[x].update(w)
            two[x].update(zip(w, w[1:]))
    limit = pair_share * sum(two[0].values())
    kept = {k for k, c in two[0].items() if c >= limit}
    context = [Counter(), Counter()]
    for x in (0, 1):
        for k in kept:
            context[x][k[0]] += two[x][k]
    out = []
    for d, w in rows:
        loss = []
        for x in (1, 0):
            total = 0
            for i, c in enumerate(w):
                p = (one[x][c] + 1) / (n[x] + len(vocabulary) + 1)
                if i:
                    pair = (w[i - 1], c)
                    p = ((two[x][pair] if pair in kept else 0) + smoothing * p) / (context[x][w[i - 1]] + smoothing)
                total -= math.log(p)
            loss.append(total / len(w) if w else None)
        out.append((d, len(w), *loss, loss[0] - loss[1] if w else None))
    return out


def _check(spark, docs, targets, word_share=0.01, pair_share=0.01, smoothing=5.0):
    df = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id bigint, text string, own int, score double").repartition(3)
    named = spark.createDataFrame([(t, "x") for t in targets], "doc_id bigint, text string")
    got = sorted(map(tuple, lm_score.scores(df, named, word_share, pair_share, smoothing).collect()), key=str)
    want = sorted(model(docs, set(targets), word_share, pair_share, smoothing), key=str)
    key = lambda r: (str(r[0]), r[1], round(r[4] or 0, 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and all(a == b or abs(a - b) < 1e-9 for a, b in zip(g[2:], w[2:]))
    return {r[0]: r for r in got}


DOCS = [(1, "The cat sat on the mat . " * 3), (2, None), (3, ""), (4, "the dog ran"), (4, "the dog ran"), (5, "the cat sat on a dog"),
        (None, "the cat"), (6, "rare words only once"), (7, "x"), (8, "cat " * 500), (4, "another text of one id")]


def test_edge_cases(spark):
    """Nulls, empty texts, ties, repeated rows, clashing columns, repeated and null labels."""
    got = _check(spark, DOCS, [1, 5, 5, 99])
    assert got[1][4] < got[8][4]  # closer to the target
    assert got[2][2:] == (None, None, None)
    _check(spark, DOCS, [])
    _check(spark, DOCS, [1], word_share=2.0, pair_share=2.0)  # no word is kept
    _check(spark, DOCS, [1], word_share=0.0, pair_share=0.0)


@pytest.mark.parametrize("limit", [0, 10])
def test_labels_beyond_the_broadcast_bound(spark, monkeypatch, limit):
    monkeypatch.setattr(lm_score, "BROADCAST_LABELS", limit)
    _check(spark, DOCS, [1, 5])


def test_empty_tables(spark):
    _check(spark, [], [])
    _check(spark, [], [1])


def test_op1_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(map(tuple, registry.op1_lm_score(spark, SF).collect())) == sorted(con.execute(registry.OP1_SQL).fetchall())


def test_shares_of_zero_collect_no_model(spark, monkeypatch):
    """Every word and pair counts, over several slices and buckets, and no counts come to the driver."""
    def collected(*args):
        raise AssertionError("model collected")

    monkeypatch.setattr(lm_score, "_collected", collected)
    monkeypatch.setattr(lm_score, "SLICE_BYTES", 300)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 200)
    _check(spark, DOCS, [1, 5], word_share=0.0, pair_share=0.0)
    _check(spark, [], [1], word_share=0.0, pair_share=0.0)
    _check(spark, [(1, None), (2, " ")], [1], word_share=0.0, pair_share=0.0)


def test_the_query_cuts_nothing(spark):
    """Rare words keep counts of their own: the defaults are the uncut models, also under the earlier name."""
    assert "HAVING" not in registry.OP1_SQL and {"op1_lm_score", "op1_lm_score_all"} <= set(registry.QUERIES)
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    got = sorted(map(tuple, lm_score.scores(df, df.where("doc_id = 1"), smoothing=5.0).collect()), key=str)
    want = sorted(model(DOCS, {1}, 0.0, 0.0, 5.0), key=str)
    assert len(got) == len(want) and all(g[:2] == w[:2] and (g[4] is None or abs(g[4] - w[4]) < 1e-9) for g, w in zip(got, want))
