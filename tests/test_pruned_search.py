"""Exact search by blocks against comparing all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from hostlens.operators import pruned_search


def _frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v] if v is not None else None) for i, v in zip(ids, vectors)],
                                 "id bigint, embedding array<float>").repartition(5)


def _plain(ids, vectors, asked, k):
    out = {}
    m = np.array(vectors, np.float32).astype(np.float64)
    for i in asked:
        q = m[ids.index(i)]
        d = np.zeros(len(m))
        for x in range(m.shape[1]):
            d += (q[x] - m[:, x]) ** 2
        order = np.lexsort((ids, d))[:k]
        out[i] = [(ids[j], d[j]) for j in order]
    return out


@pytest.mark.parametrize("k", [1, 7])
def test_equals_all_pairs(spark, monkeypatch, k):
    """Clusters, ties between equal vectors, a hot cluster, a row without a vector; fewer pairs are scored than there are."""
    monkeypatch.setattr(pruned_search, "CORPUS_BLOCK", 32)
    monkeypatch.setattr(pruned_search, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(k)
    centres = rng.normal(0, 20, (12, 6))
    vectors = [centres[0 if rng.random() < .35 else rng.integers(12)] + rng.normal(0, .5, 6) for _ in range(900)]
    for i in range(40):  # equal vectors
        vectors[i + 100] = vectors[i % 3]
    ids = list(range(900))
    rng.shuffle(ids)
    ids = [int(i) for i in ids]
    corpus = _frame(spark, ids + [5000], [*vectors, None])
    asked = [i for i in ids if i % 9 == 0]
    queries = corpus.where("id % 9 = 0 or id = 5000").withColumnRenamed("id", "query_id")
    got = {}
    for r in pruned_search.knn_blocks(corpus, queries, k=k, pivots=30).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    assert got == _plain(ids, vectors, asked, k)
    scored = sum(r["scored"] for r in pruned_search.knn_blocks(corpus, queries, k=k, pivots=30, with_scored=True).collect())
    assert scored < len(asked) * len(ids) / 2


def test_few_rows(spark):
    corpus = _frame(spark, [1, 2, 3], [[0, 0], [1, 0], [5, 5]])
    out = pruned_search.knn_blocks(corpus, corpus.where("id = 1").withColumnRenamed("id", "query_id"), k=5).orderBy("rank").collect()
    assert [(r["rank"], r["id"], r["distance"]) for r in out] == [(1, 1, 0.0), (2, 2, 1.0), (3, 3, 50.0)]
    assert pruned_search.knn_blocks(corpus.limit(0), corpus.withColumnRenamed("id", "query_id"), k=2).count() == 0
