"""Suffix sorting and both substring operators against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from hostlens.llm import registry, runs, sais, substring_sa, superkmer

SF = "/root/testdata/sf0.001"


def test_suffix_array_and_prefixes_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    for few, short, small in ((24, 2000, 1024), (24, 0, 1024), (0, 0, 1024), (0, 0, 1), (3, 5, 1)):
        monkeypatch.setattr(sais, "FEW", few)
        monkeypatch.setattr(sais, "SHORT", short)
        monkeypatch.setattr(sais, "SMALL_ALPHABET", small)
        for _ in range(250):
            s = [rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(0, 50))]
            s = s + s[:rng.randint(0, 9)]
            sa = sais.suffix_array(np.array(s, np.int64)).tolist()
            assert sa == sorted(range(len(s)), key=lambda i: s[i:])
            if s:
                got = sais.common_prefixes(np.array(s, np.uint8), np.array(sa), 6)
                for x, y in zip(sa, sa[1:]):
                    n = 0
                    while n < 6 and max(x, y) + n < len(s) and s[x + n] == s[y + n]:
                        n += 1
                    assert got[y] == n


def test_suffix_array_of_larger_texts():
    rng = random.Random(2)
    base = "".join(rng.choice("abcd ") for _ in range(3000))
    for text in (base + base[500:2500] + base, "ab" * 4000, "a" * 5000, "abc" * 1500 + base):
        b = text.encode()
        assert sais.suffix_array(np.frombuffer(b, np.uint8)).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_suffix_array_of_many_letters():
    rng = random.Random(6)
    base = [rng.randrange(5000) for _ in range(3000)]
    for s in (base + base[100:2900] + base, [7, 3000] * 2000, [3000] * 4000, list(range(4000, 0, -1)), [2**40 + x for x in base] * 2):
        assert sais.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_passages_are_sorted_in_few_steps(monkeypatch):
    """Names of passages that recur are many letters in small buckets: vectors of a few entries each cost the most."""
    steps, deal = [], sais._deal
    monkeypatch.setattr(sais, "_deal", lambda c: steps.append(len(c)) or deal(c))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    passages = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(400)]
    text = "\n".join(passages + [f"{p} more" for p in passages]).encode()
    sa = sais.suffix_array(np.frombuffer(text, np.uint8))
    assert len(steps) < 1000  # 1848 before
    some = sa[:2000].tolist()
    assert some == sorted(some, key=lambda i: text[i:]) and sorted(sa.tolist()) == list(range(len(text)))


def byte_model(docs, window):
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[i:i + window] for i in range(len(b) - window + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(bool(g and (i == 0 or not gone[i - 1])) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def word_model(docs, window):
    """Rows of one id go by the digest of their words."""
    rows = [(d, (t or "").encode().split()) for d, t in docs]
    digest = [runs.tie_of(hashlib.sha256(b" ".join(w)).hexdigest()) for _, w in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, digest[i]))
    seen, out = set(), []
    for i in order:
        d, w = rows[i]
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            if g in seen:
                gone[k:k + window] = [True] * window
            seen.add(g)
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def _frame(spark, docs):
    rows = [(*d, 3, "k") for d in docs]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int, kept string").repartition(4)


def _bytes(spark, docs, window=400, **how):
    got = substring_sa.remove_repeats(_frame(spark, docs), window, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == byte_model(docs, window)


def _noted(spark, docs, window, noted, **how):
    """Both lengths of one pass."""
    got = substring_sa.remove_repeats(_frame(spark, docs), window, noted=noted, **how).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_noted").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == byte_model(docs, window)
    assert sorted(((r.doc_id, r.n_bytes, r.n_noted) for r in got), key=str) == sorted((r[:3] for r in byte_model(docs, noted)), key=str)


def _words(spark, docs, window=20, **how):
    got = superkmer.remove_later_windows(_frame(spark, docs), window, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == word_model(docs, window)


def _passages(rng, n, letters="abcdefgh \n"):
    """Documents of random text with shared passages, near and exact copies and periodic stretches."""
    say = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [say(rng.randint(30, 700)) for _ in range(5)]
    docs = []
    for _ in range(n):
        parts = [say(rng.randint(0, 300)), rng.choice(shared), say(rng.randint(0, 90)), rng.choice(shared)[rng.randint(0, 40):]]
        if rng.random() < .2:
            parts.append(say(rng.randint(1, 60)) * rng.randint(2, 20))
        docs.append("".join(parts))
    docs += [rng.choice(docs) for _ in range(n // 4)]
    rng.shuffle(docs)
    return list(enumerate(docs))


EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "short one"), (5, "x " * 400), (6, "y" * 1500), (None, "z w " * 60), (7, "z w " * 60),
        (8, "é" * 300), (9, "q" * 399), (10, "q" * 400), (10, "other " * 70), (10, "q" * 400), (11, " ".join(map(str, range(300)))),
        (12, " ".join(map(str, range(100, 400)))), (12, " ".join(map(str, range(100, 400)))), (13, "  ".join(map(str, range(150, 250))))]


def test_edge_cases(spark):
    """Nulls, empty and short texts, periodic texts, rows of one id, repeated rows, odd white space, clashing columns."""
    _bytes(spark, EDGE)
    _noted(spark, EDGE, 400, 200)
    _words(spark, EDGE)
    _words(spark, [(i, f"only {i} " + "a b c d e f g h i j k l m n o p q r s t u v") for i in range(30)])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed):
    docs = _passages(random.Random(seed), 60)
    _bytes(spark, docs, buckets=5)
    _noted(spark, docs, 400, 200, buckets=5)
    _noted(spark, docs, 150, 70)
    _words(spark, docs, buckets=5)


def test_frequent_minimisers(spark, monkeypatch):
    """With every repeated minimiser frequent, grams are passed over and nothing is lost."""
    monkeypatch.setattr(runs, "HOT_RUNS", 2)
    docs = _passages(random.Random(7), 60)
    _bytes(spark, docs)
    _noted(spark, docs, 400, 200)
    _words(spark, docs)


def test_empty_tables(spark):
    _bytes(spark, [])
    _words(spark, [])


def test_unequal_windows_of_one_hash(monkeypatch):
    monkeypatch.setattr(superkmer, "mix64", lambda x: x * np.uint64(0))  # all hashes equal: the words decide
    texts = [(b"a b c d", (1, 0, 0)), (b"b c d a b c", (0, 0, 0)), (b"x y z", (2, 0, 0))]
    assert [f.tolist() for f in superkmer.later_windows(texts, 3)] == [[True, True], [False] * 4, [False]]


def test_op3_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, registry.op3_superkmer(spark, SF).collect())) == sorted(con.execute(registry.OP3_SQL).fetchall())


def test_op8_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op8_suffix_array(spark, "/root/testdata/sf0.01").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == byte_model(docs, 400)
    assert sorted((r.doc_id, r.n_repeated_200) for r in got) == sorted((r[0], r[2]) for r in byte_model(docs, 200))


def test_strings_without_common_surroundings_are_left_out():
    rng = random.Random(5)
    gram, say = "the gram that is least of all 32", lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    key = int(substring_sa.gram_hashes(np.frombuffer(gram.encode(), np.uint8))[0])
    one, two = say(168), say(168)
    texts = [say(90) + gram + say(90), one + gram + say(168), one + gram + say(168), say(168) + gram + two, say(70) + gram + two,
             say(100) + gram + say(100) + gram + say(100), one[70:] + gram + two[:70], one[70:] + gram + two[:70] + say(100)]
    short, long = substring_sa.may_recur([t.encode() for t in texts], [key] * 8, (200, 400))
    assert short.tolist() == [False, True, True, True, True, False, True, True] and not long.any()
    assert not substring_sa.may_recur([t.encode() for t in texts], [1] * 8, (200,))[0].any()


@pytest.mark.parametrize("window", [40, 100, 200, 400])
def test_no_string_with_a_common_window_is_left_out(window):
    rng = random.Random(window)
    say = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k)).encode()
    gram = say(32)
    key = int(substring_sa.gram_hashes(np.frombuffer(gram, np.uint8))[0])
    for before in range(window - 31):
        shared = say(before) + gram + say(window - 32 - before)
        assert substring_sa.may_recur([say(rng.randrange(50)) + shared + say(9), say(7) + shared], [key] * 2, (window,))[0].all()
