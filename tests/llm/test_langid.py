"""Language identification: gradients, held-out accuracy, independence of placement, edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import langid, registry

SF = "/root/testdata/sf0.01"


def test_gradients_equal_finite_differences():
    net = langid.Network.start(["a", "b", "c"], 3, 1)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(2)
    x = rng.integers(97, 104, (4, 7))
    x[1, 4:], x[2, 1:] = langid.PAD, langid.PAD
    y = np.array([0, 2, 1, 0])
    _, g = net.gradients(x, y)
    for k in net.NAMES:
        w = getattr(net, k)
        picks = [tuple(i) for i in np.argwhere(np.abs(g[k]) > 1e-4)[:6]]
        for i in picks:
            old, eps = w[i], 1e-2
            w[i] = old + eps
            up, _ = net.gradients(x, y)
            w[i] = old - eps
            down, _ = net.gradients(x, y)
            w[i] = old
            assert abs((up - down) / (2 * eps) - g[k][i]) < 2e-3, (k, i)


def test_segments_do_not_depend_on_neighbours():
    net = langid.Network.start(["a", "b"], 4, 3)
    docs = [b"", b"x", b"abc " * 100, "é".encode() * 64, b"q" * 129]
    alone = [langid.document_probabilities(net, np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0] if d else np.zeros(2) for d in docs]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    together = langid.document_probabilities(net, np.frombuffer(b"".join(docs), np.uint8), starts)
    assert np.allclose(together, alone, atol=1e-5)


@pytest.fixture(scope="module")
def predicted(spark):
    return registry.op4_language_id(spark, SF).collect()


def test_held_out_accuracy(spark, predicted):
    import zlib

    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"] for r in predicted} == lang.keys()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in predicted)
    held = [r for r in predicted if r["held_out"]]
    assert len(held) > 150 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_edge_cases(spark):
    """Nulls, no letters, clashing and extra columns, repeated rows, no labels, empty tables."""
    rows = [(i, t, v, 5) for i, (t, v) in enumerate([("der und die das ist " * 9, "de"), ("the and of that is " * 9, "en")] * 30)]
    rows += [(None, "the and of", None, 1), (1, None, "en", 1), (2, "", "en", 1), (3, "12 .. ²", "de", 1), (4, "the of", None, 1), (4, "the of", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int").repartition(3)
    net = langid.train(df, steps=60)
    out = langid.predict(df, net)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = [(r["doc_id"], r["text"], r["lang_pred"], r["score"]) for r in out.collect()]
    assert len(got) == len(rows)
    for _, text, label, score in got:
        if text in (None, "", "12 .. ²"):
            assert (label, score) == ("und", 0.0)
        else:
            assert label == ("de" if "der" in text else "en") and 0.5 < score <= 1
    assert langid.train(df.where("lang is null")) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.train(df.limit(0)) is None and langid.predict(df.limit(0), net).count() == 0


def test_sample_is_the_least_hashes(spark, monkeypatch):
    """The bound on hashes changes no sample, also where few texts have letters."""
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, labels, **how: seen.append(sorted(zip(texts, labels))))
    docs = spark.createDataFrame([(i, f"text {i} de" if i % 3 else "12", "de") for i in range(600)], "doc_id bigint, text string, lang string")
    few = docs.where("doc_id % 100 = 1").unionByName(docs.where("text = '12'"))
    for df in (docs, few):
        for rows in (3, 50, 1000):
            langid.train(df, sample_rows=rows)
            whole = df.where(~langid.held_out(F.col("doc_id")) & langid.has_letter(F.col("text")))
            want = whole.select("text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("k")).orderBy("k").limit(rows).collect()
            assert [t for t, _ in seen.pop()] == sorted(r["text"].encode() for r in want)
