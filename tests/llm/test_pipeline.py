"""The pipeline stage by stage against brute force, and its edge cases."""

from __future__ import annotations

import os
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from hostlens.llm import bpe
from hostlens.llm.common import saved
from hostlens.session import ensure_checkpoint_dir
from test_decontaminate import LOW, WORD
from test_partenum import model as components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def key(r):
    return (r[0] is not None, r[0] or 0, str(r))


def rows_of(df):
    return sorted((tuple(r[c] for c in C.COLUMNS) for r in df.collect()), key=key)


def model_near(rows, spark):
    """Rows of a shared id are documents of their own, numbered by their hash."""
    many = Counter(r[0] for r in rows)
    named = spark.createDataFrame(sorted({r[:2] for r in rows if r[0] is not None and many[r[0]] > 1}, key=str), "d bigint, t string")
    hashed = {(r[0], r[1]): -1 - (r[2] & 2**63 - 1) for r in named.selectExpr("d", "t", "xxhash64(d, t)").collect()}
    keys = [hashed.get((r[0], r[1]), r[0]) for r in rows]
    groups = components([(k, r[1]) for k, r in zip(keys, rows)], size=C.SHINGLE, percent=C.PERCENT)
    least = {d for d, _, c in groups if d is not None and d == c}
    out = {}
    for k, r in sorted(zip(keys, rows), key=lambda x: (x[1][1] is not None, x[1][1] or "")):
        if k in least:
            out.setdefault(k, r)
    return sorted([*out.values(), *(r for r in rows if r[0] is None)], key=key)


def model_repeats(rows):
    w, seen = C.REPEAT_BYTES, Counter()
    for r in rows:
        b = (r[1] or "").encode()
        seen.update(b[i:i + w] for i in range(len(b) - w + 1))
    out = []
    for d, t, lang, source, n in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if seen[b[i:i + w]] > 1:
                gone[i:i + w] = b"\1" * w
        if any(gone):
            at, kept = 0, []
            for c in t:  # a character of which a byte goes goes whole
                size = len(c.encode())
                if not any(gone[at:at + size]):
                    kept.append(c)
                at += size
            t = "".join(kept)
            n = len(t)
        out.append((d, t, lang, source, n))
    return sorted(out, key=key)


def model_leaks(rows, items):
    wins = set()
    for t in items:
        w = WORD.findall((t or "").translate(LOW))
        wins |= {tuple(w[k:k + 10]) for k in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in wins}

    def hit(t):
        w = WORD.findall((t or "").translate(LOW))
        return any(tuple(w[i:i + n]) in wins for n in sizes for i in range(len(w) - n + 1))

    return [r for r in rows if not hit(r[1])]


def check(spark, docs, sf_dir):
    """Every stage on what its predecessor kept; returns the rows after each."""
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    models = {"near_duplicates": lambda r: model_near(r, spark), "repeated_substrings": model_repeats, "benchmark": lambda r: model_leaks(r, items)}
    before, after = rows_of(docs), {}
    for name, stage in C.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == C.COLUMNS
        now = rows_of(docs)
        if name in models:
            assert now == models[name](before), name
        else:
            assert all(r in before for r in now)
        before = after[name] = now
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    last = C.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert all(r["round_trip"] for r in last)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in last) == sorted((str(r[0]), tik.encode_ordinary(r[1] or "")) for r in before)
    return after


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    after = check(spark, docs, SF)
    assert len(after["language"]) > 0.97 * n
    assert len(after["near_duplicates"]) < len(after["language"])
    assert len(after["benchmark"]) < len(after["repeated_substrings"])
    assert C.run(spark, SF).count() == len(after["benchmark"])


def test_planted_cases(spark, tmp_path):
    """Copies, near copies, leaks, shared passages, nulls, tied ids and an extra column; clean documents stay."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeiounthrsld") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    spark.createDataFrame([(1, say(25)), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    item = spark.read.parquet(f"{tmp_path}/benchmark.parquet").where("item_id = 1").first()["text"]
    clean = [(i, say(rng.randint(80, 200))) for i in range(40)]
    shared = say(60)
    near = clean[3][1].split()
    near[50] = "changed"
    docs = clean + [(50, clean[0][1]), (51, " ".join(near)), (52, f"{say(60)} {item} {say(30)}"), (53, f"{say(50)} {shared} {say(40)}"),
                    (54, f"{say(45)} é{shared}"), (55, None), (56, "123 456"), (57, ""), (60, say(70)), (60, say(70)), (None, say(75)), (61, "é" * 300), (62, "aé" * 150)]
    df = spark.createDataFrame([(d, t, "xx", "s", len(t or ""), 1) for d, t in docs], SCHEMA + ", row int").repartition(3)
    after = check(spark, df, str(tmp_path))
    ids = lambda name: [r[0] for r in after[name]]
    assert {55, 56, 57}.isdisjoint(ids("language")) and set(range(40)) <= set(ids("benchmark"))
    assert {50, 51}.isdisjoint(ids("near_duplicates")) and ids("near_duplicates").count(60) == 2
    assert 52 not in ids("benchmark") and None in ids("benchmark")
    texts = {r[0]: r[1] for r in after["repeated_substrings"]}
    assert shared not in texts[53] and shared not in texts[54] and all(texts[d] == t for d, t in clean)


@pytest.mark.parametrize("rows, left", [([], []), ([(1, "some words", None, None, None), (2, "12 34", None, None, None)], [1])])
def test_empty_and_unlabelled(spark, rows, left):
    """Without a label there is nothing to reject by but the lack of letters."""
    df = spark.createDataFrame(rows, SCHEMA)
    for _, stage in C.STAGES:
        df = saved(stage(spark, df, SF), "test")
    assert [r["doc_id"] for r in df.collect()] == left


def test_small_tables_of_many_partitions_are_written_to_few_files(spark):
    """Every file starts processes on a local file system; the result does not depend on their number."""
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(90)) for _ in range(40)]
    rows = [(i, base[i % 40] + f" end{i}", "xx", "s", 1) for i in range(200)]
    folder = f"{ensure_checkpoint_dir(spark)}/hostlens-llm"
    held = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    old = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        near = saved(C.near_duplicates(spark, docs, SF), "test-near")
        assert rows_of(near) == model_near(rows, spark)
        cut = saved(C.repeated_substrings(spark, docs, SF), "test-cut")
        assert rows_of(cut) == sorted(model_repeats(rows), key=key)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {d.rsplit("-", 1)[0]: sum(f.startswith("part-") for f in os.listdir(f"{folder}/{d}")) for d in set(os.listdir(folder)) - old}
    assert {"classes", "lists", "edges", "minimisers", "marks", "test-near", "test-cut"} <= set(files)
    assert max(files.values()) <= 2 * spark.sparkContext.defaultParallelism  # 37 before


def test_documents_that_share_only_an_id_stay(spark):
    """Shards with clashing ids: unlike texts of one id stay, copies go whatever their ids."""
    rng = random.Random(10)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = [say(40) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (2, texts[3]), (3, texts[3]), (4, texts[4]), (5, texts[4]), (5, None), (5, ""), (6, texts[5])]
    rows = [(d, t, "xx", "s", len(t or "")) for d, t in rows]
    got = rows_of(C.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SF))
    assert got == model_near(rows, spark)
    assert Counter(r[1] for r in got if r[1]) == Counter(texts)


def test_replacement_characters_of_unrepeated_text_stay(spark):
    """U+FFFD goes only where a repeat took it; halves of cut characters go."""
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = say(60)
    docs = [(1, f"{say(20)} \ufffd {shared} \ufffd"), (2, f"\ufffd{say(20)} é{shared}"), (3, f"{say(9)} è{shared}"), (4, "\ufffd x"), (None, f"\ufffd{shared}")]
    rows = [(d, t, "xx", "s", len(t)) for d, t in docs]
    got = rows_of(C.repeated_substrings(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SF))
    assert got == model_repeats(rows)
    texts = {r[0]: r[1] for r in got}
    assert texts[1].count("\ufffd") == 2 and texts[2].startswith("\ufffd") and shared not in texts[1]
