"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hostlens.llm import periodic, registry

SF = "/root/testdata/sf0.001"


def brute_runs(w, least_words=6, least_exponent=4):
    found = {}
    for p in range(1, len(w) // least_exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            size = i + p - start
            if size >= max(least_words, least_exponent * p):
                found.setdefault((start, size), p)  # periods ascend: the smallest comes first
    return sorted((s, n, p) for (s, n), p in found.items())


def brute(w):
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    exact = [r for r in runs if r[1] * best[2] == best[1] * r[2]] if best else []
    return runs, (min(exact) if exact else None), " ".join(x for i, x in enumerate(w) if i not in gone)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_extensions(seed):
    """Longest common extensions against comparing word by word, both ways."""
    rng = random.Random(seed)
    w = [rng.randrange(1 + seed) for _ in range(500)] + [7, 8] * 90 + [5] * 70
    w = np.array([-1, *w, -1], np.int32)
    levels = periodic.grammar(w, enough=4)
    mirror = [x.mirrored() for x in levels]
    a = np.array([rng.randrange(1, len(w) - 2) for _ in range(3000)])
    b = np.array([rng.randrange(x + 1, len(w) - 1) for x in a])
    right = periodic.common_extension(levels, a, b)
    left = periodic.common_extension(mirror, len(w) - b, len(w) - a)
    for x, y, r, m in zip(a.tolist(), b.tolist(), right.tolist(), left.tolist()):
        k = 0
        while w[x + k] == w[y + k]:
            k += 1
        assert r == k
        k = 0
        while w[x - 1 - k] == w[y - 1 - k]:
            k += 1
        assert m == k


@pytest.mark.parametrize("seed", range(8))
def test_find_runs(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(60))] * rng.choice([1, 1, 4, 9]) +
             [rng.randrange(3)] * rng.randrange(12) for _ in range(60)] + [[], [1], [2] * 5, [2] * 6]
    n = np.array([len(t) for t in texts])
    first = np.cumsum(n + 1) - n
    word = np.array([x for t in texts for x in [-1, *t]] + [-1], np.int32)
    got = periodic.find_runs(word, first, n).tolist()
    assert got == [[k, *r] for k, t in enumerate(texts) for r in brute_runs(t)]
    assert periodic.find_runs(word, first, n, 5, 3).tolist() == [[k, *r] for k, t in enumerate(texts) for r in brute_runs(t, 5, 3)]


def test_small_parts(monkeypatch):
    monkeypatch.setattr(periodic, "MOST_CANDIDATES", 3)
    test_find_runs(1)


def test_op12_on_documents(spark):
    got = {r["doc_id"]: r for r in registry.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got.keys() == {d["doc_id"] for d in docs}
    some = 0
    for d in docs:
        runs, best, kept = brute(planted(d["doc_id"], d["text"]))
        r = got[d["doc_id"]]
        some += bool(runs)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert some > 5


def test_edge_cases(spark):
    """Nulls, empty and long texts, odd white space, repeated rows, clashing columns; an empty table."""
    long = " ".join(str(k % 977) for k in range(120_000)) + " x" * 50_000
    texts = [None, "", " \t\n", "a a a a a a", "a a a a a", "x y x y x y x y", "a\x0ba\x0ca\ra\na\ta z", "é é é é é é é 中", "a a a a a a", long]
    rows = [(i if i != 2 else None, t, "n", [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, runs array<int>").repartition(3)
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "best", "collapsed"]

    def row(text):
        w = words(text)
        if text is long:
            best, runs = (120_000, 50_000, 1), [(0, 120_000, 977), (120_000, 50_000, 1)]
            return len(w), tuple(runs), best, " ".join([*w[:977], "x"])
        runs, best, kept = brute(w)
        return len(w), tuple(runs), best, kept

    got = Counter((r["doc_id"], r["text"], r["n_words"], tuple(map(tuple, r["runs"])), r["best"] and tuple(r["best"])[:3], r["collapsed"]) for r in out.collect())
    assert got == Counter((i, t, *row(t)) for i, t, *_ in rows)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
