"""Cross-tokenizer alignment against token-by-token brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from hostlens.llm import cross_align, registry
from hostlens.llm.token_orc import byte_letters

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " ", "  two  spaces ", "a\n b \nc", "<|endoftext|> </s> <s>x", "▁own mark", "a ▁", "it's we'll",
        "中文 \U0001f600 é x", "<0x41>", "ab" * 9000 + " x", "dup text", "dup text", "tail \n\n", "the the the theatre"]
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def brute(texts):
    a_tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    byte_of = {c: b for b, c in byte_letters().items()}

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()

    docs, held = [], Counter()
    for text in texts:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a]
        b_parts = [b_bytes(i) for i in b]
        whole = b" " + text.encode() if text else b""
        if b"".join(a_bytes) != whole or b"".join(b_parts) != whole:
            a, b, a_bytes, b_parts = [], [], [], []
        links, i, j, ea, eb, groups, ga, gb = [], 0, 0, 0, 0, [], [], []
        spans_a = np.cumsum([0] + [len(x) for x in a_bytes]).tolist()
        spans_b = np.cumsum([0] + [len(x) for x in b_parts]).tolist()
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            ga += [] if ga and ga[-1][0] == i else [(i, a[i])]
            gb += [] if gb and gb[-1][0] == j else [(j, b[j])]
            ea, eb = spans_a[i + 1], spans_b[j + 1]
            i, j = i + (ea <= eb), j + (eb <= ea)
            if ea == eb:
                groups.append(",".join(str(x) for _, x in ga) + "|" + ",".join(str(x) for _, x in gb))
                ga, gb = [], []
        docs.append((a, b, groups, links))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(len(a), len(b), len(g), len(k), sum(held[x] == best[x[0]] for x in k), sum(held[x] for x in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, k in docs]


def test_perfect_hash():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**45, 30_000))
    where = cross_align.bucket_of(keys, 7)
    parts = []
    for b in range(7):
        sizes, bits, order = cross_align.build_bucket(keys[where == b])
        parts.append((b, sizes, np.packbits(bits).tobytes(), order.tobytes()))
    h = cross_align.PerfectHash(parts, 7)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(rng.integers(0, 2**45, 5000), keys)
    assert (h.index(others) == -1).all()
    assert len(h.index(np.zeros(0, np.int64))) == 0


def _texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op11_on_documents(spark):
    texts = _texts(spark)
    want = dict(zip(texts, brute(list(texts.values()))))
    got = {r["doc_id"]: tuple(r[c] for c in [*NAMES, "groups_sha256"]) for r in registry.op11_cross_align(spark, SF).collect()}
    assert got == want


def test_edge_cases_and_shards(spark, monkeypatch):
    """Nulls, ties, repeated rows, clashing columns; counts from several shards of many buckets, summed as a tree."""
    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(EDGE)] + [(3, EDGE[3], "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string").repartition(5)
    want = Counter((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows])))

    def got(**options):
        out = cross_align.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), **options).collect()
        return Counter((r["doc_id"], *[r[c] for c in NAMES], hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "") for r in out)

    assert got() == want
    monkeypatch.setattr(cross_align, "BUCKET_KEYS", 16)
    monkeypatch.setattr(cross_align, "FAN", 2)
    assert got(most_keys=40) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert cross_align.align(empty, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0
