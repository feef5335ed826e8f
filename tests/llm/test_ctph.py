"""Piecewise hashes against a byte-by-byte model, and the neighbours of with_edits."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import ctph, registry

SF = "/root/testdata/sf0.001"


def model_fingerprint(data: bytes):
    """Plain loop over bytes."""
    n = len(data)
    least = max(int(np.floor(np.log2(max(n, 1) / 192))) - 4, 0)
    marks = []
    for i in range(6, n):
        w = data[i - 6:i + 1]
        h = sum(w) + sum((k + 1) * c for k, c in enumerate(w))
        x = 0
        for c in w:
            x = ((x << 5) ^ c) & 0xFFFFFFFF
        h = (h + x + 1) & 0xFFFFFFFF
        if h and h % 3 == 0:
            v, level = h // 3, 0
            while v % 2 == 0:
                v, level = v // 2, level + 1
            marks.append((i + 1, level))

    def letters(k):
        cuts = [0, *[p for p, lv in marks if lv >= k and p < n], n]
        out = ""
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                h = sum((c + 1) * pow(ctph.BASE, j, 2**64) for j, c in enumerate(data[a:b])) % 2**64
                out += chr(ctph.LETTERS[int(ctph.mix64(np.array([h], np.uint64))[0]) >> 58])
        return out

    k = least
    while len(letters(k)) > 64:
        k += 1
    return f"{3 << k}:{letters(k)}:{letters(k + 1)}"


def model_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def model_likeness(a, b):
    if a == b:
        return 1.0
    (ka, a1, a2), (kb, b1, b2) = ((int(x.split(":")[0]), *x.split(":")[1:]) for x in (a, b))
    pairs = [(x, y) for s, x in ((ka, a1), (2 * ka, a2)) for t, y in ((kb, b1), (2 * kb, b2)) if s == t and x and y]
    return max((1 - model_distance(x, y) / max(len(x), len(y)) for x, y in pairs), default=0.0)


def _rows(texts):
    return ctph._text(ctph.fingerprint_rows(*ctph._byte_rows(texts)))


def test_fingerprints_equal_the_model(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "abcdefg", "a" * 3000, "\0" * 50, "ab" * 900] + [
        "".join(rng.choice("abcdefghij éß\n") for _ in range(rng.randint(1, 4000))) for _ in range(25)]
    want = [model_fingerprint(t.encode()) for t in texts]
    assert _rows(texts) == want
    monkeypatch.setattr(ctph, "BLOCK", 1000)  # texts over several blocks, same results
    ctph.worker_cache("ctph").clear()
    assert _rows(texts) == want
    ctph.worker_cache("ctph").clear()


def test_distance_equals_the_model():
    rng = random.Random(4)
    a = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 64))) for _ in range(300)]
    b = [x if rng.random() < .1 else "".join(c for c in x if rng.random() > .2) + rng.choice(["", "zz"]) for x in a]
    b = [x[:64] for x in b]
    got = ctph._edit_distance([x.encode() for x in a], [x.encode() for x in b])
    assert got.tolist() == [model_distance(x, y) for x, y in zip(a, b)]


def _check(docs, got):
    """docs: (doc_id, text) in order; got: result rows."""
    texts = [t or "" for _, t in docs]
    edited = [t[:len(t) - len(t) // 4] + n[:len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1])]
    fp, fe = _rows(texts), _rows(edited)
    want = [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, model_likeness(f, g), model_likeness(f, h))
            for (d, _), t, e, f, g, h in zip(docs, texts, edited, fp, fe, fp[1:] + fp[:1])]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted([tuple(w) for w in want], key=key)


def test_op10_on_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = registry.op10_piecewise_hash(spark, SF).collect()
    _check(docs, got)
    long = [r for r in got if r["n_chars"] > 500]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.95 * len(long)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_neighbours_edge_cases(spark, parts):
    """Null id and text, empty text, repeated rows, ties, an extra clashing column."""
    docs = [(None, "no id"), (1, None), (2, ""), (3, "abc"), (3, "abd"), (3, "abd"), (5, "é" * 50), (6, "x" * 4000), (9, "tail text")]
    df = spark.createDataFrame([(*d, "f") for d in docs], "doc_id bigint, text string, fingerprint string").repartition(4)
    _check(docs, ctph.with_edits(df, parts=parts).collect())


def test_single_and_empty_tables(spark):
    _check([(4, "only one")], ctph.with_edits(spark.createDataFrame([(4, "only one")], "doc_id bigint, text string")).collect())
    assert ctph.with_edits(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_fingerprint_and_likeness_columns(spark):
    df = spark.createDataFrame([(1, "same text", 0), (2, "same text", 0), (3, None, 0)], "doc_id bigint, text string, fingerprint int")
    out = ctph.fingerprints(df)
    assert out.columns == ["doc_id", "text", "fingerprint"]
    rows = out.withColumn("l", ctph.likeness(F.col("fingerprint"), F.lit("3::"))).orderBy("doc_id").collect()
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and (rows[0]["l"], rows[2]["l"]) == (0.0, 1.0)
