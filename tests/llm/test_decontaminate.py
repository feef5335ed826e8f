"""Decontamination against a plain scan and against SQL."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from hostlens.llm import decontaminate, registry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(docs, items):
    wins = []
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        wins += [(i, w[k:k + 10]) for k in range(max(len(w) - 9, 1))] if w else []
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k:k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(str(i) if i is not None else "")
        names = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _check(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, hits string, row int").repartition(3)
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id bigint, text string, win int")
    got = decontaminate.contamination(d, b).select(*COLS).collect()
    assert sorted(map(tuple, got), key=str) == model(docs, items)


def test_edge_cases(spark):
    """Short items, nulls, overlaps, repeated rows and items, upper case beyond ASCII, very common windows."""
    rng = random.Random(2)
    items = [(1, "One"), (2, "two words"), (3, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k l"), (4, None), (5, " .,"),
             (6, "the the the the the the the the the the the"), (10, "b c d e f g h i j k"), (11, "Été où"), (12, "uniq-uely Here")]
    docs = [(1, "x one. two  WORDS two words"), (2, None), (3, ""), (4, "A b c d e f g h i j k l m"), (4, "A b c d e f g h i j k l m"),
            (5, "the " * 300), (6, "c d e f g h i j k l"), (7, "été où Été où"), (None, "words two words"), (8, "a b c d e f g h i j"),
            (9, "x " * 2000 + "b c d e f g h i j k"), (10, "\x00one\x7fone one")]
    docs += [(20 + i, " ".join(rng.choice("abcdefghijkl") for _ in range(200))) for i in range(10)]
    _check(spark, docs, items)


def test_long_windows_only(spark):
    """Planted passages of items at the ends and in the middle, whole and cut short."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(3, 40))) for i in range(30)]
    docs = []
    for i in range(60):
        parts = items[rng.randrange(30)][1].split()
        cut = rng.randint(0, 8)
        docs.append((i, " ".join([say(rng.randint(0, 60)), *parts[cut:], say(rng.randint(0, 60))])))
    _check(spark, docs, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a b")]), ([(1, "a b")], []), ([], []), ([(1, None)], [(1, None)])])
def test_empty_tables(spark, docs, items):
    _check(spark, docs, items)


def test_shuffle_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 6)  # a saturated bit table changes no result
    _check(spark, [(1, "p q r s t u v w x y z a b c"), (2, "q q")], [(7, "p q r s t u v w x y z"), (8, "q")])


def test_op6_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = sorted(con.execute(registry.OP6_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in registry.op6_decontaminate(spark, "/root/testdata/sf0.001").collect()), key=str) == want
    assert any(r[5] for r in want)
