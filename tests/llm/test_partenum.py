"""PartEnum join against brute force and SQL; hashed words against a plain split."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import common, partenum, registry, runs

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return (text or "").encode().translate(LOW).split()


def model(docs, size=3, percent=90, pieces=3):
    """Components by comparing all sets; rows of one id are one node."""
    sets = []
    for _, t in docs:
        w = words_of(t)
        sets.append({tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = docs[i][0] is not None and docs[i][0] == docs[j][0]
            linked = sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j])
            if linked and (None not in (docs[i][0], docs[j][0]) or sets[i] == sets[j]) or same_id and sets[i] and sets[j]:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def _check(spark, docs, **how):
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id bigint, text string, n int, rep string").repartition(4)
    got = partenum.similar_components(df, **how).collect()
    assert sorted(map(tuple, got), key=str) == model(docs, **how)


def _near_copies(rng, families, copies, length):
    vocab = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 5))) for _ in range(500)]
    docs = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(*length))]
        for _ in range(rng.randint(1, copies)):
            w = [x for x in base if rng.random() > .004]
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("length", [(1, 30), (20, 120), (100, 900)])
def test_near_copies(spark, length):
    docs = _near_copies(random.Random(length[1]), 25, 9, length)
    _check(spark, docs)
    assert any(c != d for d, _, c in model(docs))


def test_blocks_of_a_large_family(spark, monkeypatch):
    """One family over several blocks gives the same components."""
    monkeypatch.setattr(partenum, "BLOCK_SETS", 8)
    docs = _near_copies(random.Random(5), 2, 60, (60, 80))
    _check(spark, docs)
    monkeypatch.setattr(partenum, "FEW", 2)  # links among many
    _check(spark, docs)


@pytest.mark.parametrize("few", [3, 64])
def test_signatures_over_batch_ends(spark, monkeypatch, few):
    """A signature's rows read in many batches, by few and by many sets; chains of sets unlike the first."""
    monkeypatch.setattr(partenum, "FEW", few)
    rng = random.Random(few)
    docs = _near_copies(rng, 3, 30, (60, 90)) + _near_copies(rng, 20, 3, (5, 20))
    words = [f"w{k}" for k in range(60)]
    for step in range(25):  # a chain: neighbours are similar, its ends are not
        words[step * 2 % 60] = f"v{step}"
        docs.append((0, " ".join(words)))
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        _check(spark, docs)
        _check(spark, docs, size=5, percent=80, pieces=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _sharing_a_line(rng, n, length=180):
    """Unlike documents that hold one common passage."""
    vocab = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    line = [rng.choice(vocab) for _ in range(length // 3)]
    return [" ".join(rng.choice(vocab) for _ in range(length)) + " " + " ".join(line) for _ in range(n)]


def test_unlike_sets_of_one_list_make_no_rows_by_the_square(spark, monkeypatch):
    """Twice as many unlike sets that share signatures: the rows that are dealt to be compared grow no faster."""
    monkeypatch.setattr(partenum, "FEW", 4)
    monkeypatch.setattr(partenum, "BLOCK_SETS", 8)
    made = []

    def counted(call):
        def run(*args):
            out = call(*args)
            made[-1] += out.count()
            return out
        return run

    for name in ("_dealt", "_meetings"):
        monkeypatch.setattr(partenum, name, counted(getattr(partenum, name, None)), raising=False)
    texts = _sharing_a_line(random.Random(3), 400)
    for n in (200, 400):
        made.append(0)
        df = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id bigint, text string").repartition(4)
        assert all(r["component_id"] == r["doc_id"] for r in partenum.similar_components(df, 5, 80, 2).collect())
    assert made[1] <= 2.5 * made[0] + 400


def test_crowds_of_unlike_and_nearly_similar_sets(spark, monkeypatch):
    """Lists of many families, in small blocks and batches: sets that share a line, copies at the limit, chains."""
    for name, most in (("FEW", 3), ("BLOCK_SETS", 8), ("HELD", 4)):
        monkeypatch.setattr(partenum, name, most)
    rng = random.Random(12)
    texts = _sharing_a_line(rng, 40, 60)
    for changed in (2, 4, 6):  # of one text, each with about as many words of its own as the limit allows
        base = texts[0].split()
        for _ in range(25):
            w = list(base)
            for i in rng.sample(range(len(w)), rng.randint(0, changed)):
                w[i] = f"own{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        _check(spark, list(enumerate(texts)))
        _check(spark, list(enumerate(texts)), size=5, percent=80, pieces=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sets_of_different_families_meet_once(spark, monkeypatch):
    """Every such pair of an element, whatever the blocks; elements of the same sets once, by the first in the order."""
    monkeypatch.setattr(partenum, "BLOCK_SETS", 8)
    rng = random.Random(6)
    rows = [(1, i, 50, 50 - i % 3, 7 if i < 100 else i // 2) for i in range(120)]
    rows += [(2, *r[1:3], r[3] - 1, r[4]) for r in rows] + [(3, i, 50, 40, i // 9) for i in range(70)] + [(4, i, 50, 45, 5) for i in range(30)]
    rng.shuffle(rows)
    dealt = partenum._meetings(spark.createDataFrame(rows, partenum.RARE).repartition(3)).collect()
    assert {r["element"] for r in dealt} == {1, 3}
    tasks, met = {}, []
    for r in dealt:
        tasks.setdefault((r["element"], r["one"], r["two"]), []).append(r)
    for (e, one, two), some in tasks.items():
        met += [(e, *sorted((x["rep"], y["rep"]))) for i, x in enumerate(some) for y in some[:i]
                if x["component"] != y["component"] and (one == two or x["block"] != y["block"])]
    wanted = {(x[0], *sorted((x[1], y[1]))) for x in rows for y in rows if x[0] == y[0] != 2 and x[4] != y[4]}
    assert len(met) == len(set(met)) and set(met) == wanted
    assert sum(r["element"] == 1 and r["component"] == 7 for r in dealt) == 100 * 3  # 20 others are three blocks


@pytest.mark.parametrize("held", [3, 1 << 16])
def test_mixed_elements_over_batch_ends(spark, monkeypatch, held):
    monkeypatch.setattr(partenum, "HELD", held)
    rng = random.Random(held)
    rows = [(e, rng.randrange(10**6), 9, 9, rng.choice([1, 1, 2]) if e % 3 else 1) for e in range(60) for _ in range(rng.choice([1, 2, 3, 17]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = sorted(map(tuple, partenum._mixed_groups(spark.createDataFrame(rows, partenum.RARE).repartition(3)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    family = {e: {r[4] for r in rows if r[0] == e} for e in range(60)}
    wanted = sorted(r for r in rows if len(family[r[0]]) > 1)
    if held > 17:
        assert got == wanted
    else:  # long groups of one family may come too
        assert len(set(got)) == len(got) and set(wanted) <= set(got) <= set(rows)


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_components(spark, monkeypatch, most):
    """A path, a star, a cycle, repeated and null edges, by rounds and in one task, against a plain search."""
    from hostlens.llm import components

    monkeypatch.setattr(components, "ONE_TASK", most)
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(200, 300 + k) for k in range(30)] + [(400 + k, 400 + (k + 1) % 9) for k in range(9)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5, 5), (None, 6), (101, 100)]
    least = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    got = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)).collect()
    assert {r["node"]: r["component"] for r in got} == least and len(got) == len(least)
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components.connected_components(none).count() == 0


def test_edge_cases(spark):
    """Nulls, empty texts, short texts, equal sets, rows of one id, case, a long word, other similarity and size."""
    long = "w" * 40000
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "A"), (6, "a b"), (7, "b a"), (8, "a b c"), (9, "A B\tC"), (10, "c a b c a b c"),
            (11, "x y z x y z x y z"), (12, "É a b"), (13, "é a b"), (14, long), (15, long + " "), (16, long + "w"), (None, "a b c"), (None, "none"),
            (20, "q r s t"), (20, "k l m n o"), (21, "k l m n o"), (19, "q r s t"), (22, "dup"), (22, "dup"), (23, "a b c")]
    _check(spark, docs)
    _check(spark, docs + [(30 + i, "u v w x y z " * 3 + str(i)) for i in range(5)], size=2, percent=60, pieces=2)


def test_empty_table(spark):
    _check(spark, [])


@pytest.mark.parametrize("pieces", [2, 3, 4])
@pytest.mark.parametrize("percent", [90, 80])
def test_signatures_meet_for_similar_sets(pieces, percent):
    """Every pair at the limit shares a signature, over all sizes of small bands and random larger ones."""
    rng = np.random.default_rng(pieces)
    for n in [*range(1, 60), 100, 333, 800]:
        for m in range(n, n * 100 // percent + 1):
            both = -(-percent * (n + m) // (100 + percent))
            if both > n:
                continue
            pool = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n:]]))
            sig, row = partenum.signatures(np.concatenate([a, b]), np.array([0, n, n + m]), percent, pieces)
            if n != both or m != both:
                assert set(sig[row == 0]) & set(sig[row == 1]), (n, m, both)


def test_hashed_words_equal_split():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\té.") for _ in range(rng.randint(0, 30))).encode() for _ in range(300)] + [b"z" * 50000 + b" z", b""]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first, end, row, h = common.hashed_words(raw, starts)
    got = [[] for _ in texts]
    for a, b, r in zip(first, end, row):
        got[r].append(raw[a:b].tobytes())
    assert got == [t.split() for t in texts]
    flat = [w for ws in got for w in ws]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_op9_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in registry.op9_jaccard_join(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(con.execute(registry.OP9_SQL).fetchall())


def test_batches_shorter_than_a_shingle():
    """A batch of two words and shingles of five: each row is its whole sequence."""
    for texts in (["some words"], ["one", "", "two"], [""]):
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        _, offsets = partenum.shingle_sets(raw, starts, 5)
        assert np.diff(offsets).tolist() == [1 if t else 0 for t in texts]


def test_bit_tables_do_not_stand_in_plans(spark):
    """Spark writes a plan's text for every stage and keeps it in the driver; the table is data, of many digits."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(5000)] + [(None, "none")], "doc_id bigint, text string")
    ids = spark.range(0, 5000, 5).withColumnRenamed("id", "doc_id")
    some = partenum._listed(docs, ids)
    marks = ids.selectExpr("doc_id", "doc_id as tie", "9 as span", "cast('x' as binary) as ranges")
    marked = runs.marked_texts(docs, marks, 5001)
    for df in (some, marked):
        assert len(df._jdf.queryExecution().toString()) < 20_000  # over 100,000 before
    found = {r["doc_id"] for r in some.collect()}
    assert set(range(0, 5000, 5)) <= found and len(found) < 1100
    assert sorted(r["doc_id"] for r in marked.collect()) == list(range(0, 5000, 5))


def test_listed_rows_and_the_rest_are_all_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] * 2 + [(None, "none"), (None, None)], "doc_id bigint, text string")
    h = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    hashes = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("h"))
    some, rest = (common.listed(docs, h, hashes, hashes.count(), how) for how in ("left_semi", "left_anti"))
    assert some.columns == rest.columns == docs.columns
    got = [[tuple(r) for r in x.collect()] for x in (some, rest)]
    assert Counter(got[0] + got[1]) == Counter(tuple(r) for r in docs.collect())
    assert not {r[0] for r in got[0]} & {r[0] for r in got[1]}
    assert {(i, f"t{i}") for i in range(0, 3000, 7)} <= set(got[0]) and {(None, "none"), (None, None)} <= set(got[1])
    none = spark.range(0).select(F.xxhash64("id").alias("h"))
    assert common.listed(docs, h, none, 0).count() == 0 and common.listed(docs, h, none, 0, "left_anti").count() == docs.count()
