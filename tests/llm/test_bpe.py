"""BPE operators against the tokenisation libraries."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from hostlens.llm import bpe, registry, token_orc

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " ", "  two  spaces ", "a\n b \nc", " x  y", "<|endoftext|> <|endoftext|>", "a <|endoftext|> b  <|endoftext|>c <|endoftext|>\nd", "it's we'll I'd 's",
        "İstanbul 中文 \U0001f600\U0001f600", "a" * 3000, "ab" * 1500 + " x", " " * 700, "\n" * 600 + "z",
        "".join(random.Random(5).choice("eiounthr \n") for _ in range(5000)), "dup text", "dup text"]


@pytest.fixture(scope="module")
def tik():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def edge_docs(spark):
    rows = [(i // 2 if i > 14 else i, t, "x") for i, t in enumerate(EDGE)] + [(None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)


def test_matrix_merge_equals_tiktoken(tik):
    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    rng = random.Random(1)
    texts = EDGE + ["".join(rng.choice(a) for _ in range(rng.randint(0, 900)))
                    for a in ("ab", "the \n", "0123456789", "éü ßñ'sd", "=-_ ", "中文 a") for _ in range(40)]
    assert [x.tolist() for x in codec.encode_texts(texts)] == [tik.encode_ordinary(t or "") for t in texts]


def test_every_character_beside_spaces(tik):
    """Chunk boundaries agree with both libraries for all kinds of white space, letters and marks."""
    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    texts = [f"a {c} b{c}{c} c{c} .{c}" for c in map(chr, [*range(0x3100), *range(0xFE00, 0x10000)])]
    assert [x.tolist() for x in codec.encode_texts(texts)] == [tik.encode_ordinary(t) for t in texts]
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_orc.chunk_encoder(f.read(), "test")
    assert [x.tolist() + [0] for x in encoder.encode(texts)] == _library(texts)


def test_encode_decode_frame(spark, tik):
    """Nulls, empty and long texts, repeated rows, an extra column of the output's name."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(edge_docs(spark), path, P.PATTERN)
    assert ids.columns == ["doc_id", "text", "ids"]
    rows = bpe.decode(ids, path, P.PATTERN).collect()
    assert len(rows) == len(EDGE) + 1
    for r in rows:
        assert r["ids"] == tik.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    both = bpe.round_trip(edge_docs(spark), path, P.PATTERN).collect()
    assert sorted(map(str, both)) == sorted(map(str, rows))
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0
    assert bpe.decode(bpe.encode(empty, path, P.PATTERN), path, P.PATTERN).count() == 0


def test_op5_on_documents(spark, tik):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.op5_byte_bpe(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        want = tik.encode_ordinary(t or "")
        assert got[k]["n_tokens"] == len(want)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def _library(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]


def _check_starts(rows, want):
    start = 0
    for r, ids in zip(rows, want):
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_op2_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = registry.op2_token_orc(spark, SF).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    _check_starts(rows, _library([d["text"] or "" for d in docs]))


def test_token_files_edge_cases(spark, tmp_path):
    """Nulls, ties, an extra clashing column, an empty table; look-ups by id."""
    path = P.path("byte_bpe_50k.json")
    token_orc.write_tokens(edge_docs(spark), path, f"{tmp_path}/a", files=3)
    got = token_orc.with_ids_crc32(token_orc.read_tokens(spark, f"{tmp_path}/a")).orderBy("start").collect()
    assert len(got) == len(EDGE) + 1 and got[0]["doc_id"] is None
    assert [r["doc_id"] for r in got[1:]] == sorted(r["doc_id"] for r in got[1:])
    full = {r["start"]: r["ids"] for r in token_orc.read_tokens(spark, f"{tmp_path}/a").collect()}
    assert sorted(map(tuple, full.values())) == sorted(map(tuple, _library([t or "" for t in EDGE] + ["no id"])))
    _check_starts(got, [full[r["start"]] for r in got])
    assert [r["doc_id"] for r in token_orc.lookup(spark, f"{tmp_path}/a", [9]).collect()] == [9]
    token_orc.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), path, f"{tmp_path}/b")
    assert token_orc.read_tokens(spark, f"{tmp_path}/b").count() == 0


def test_files_are_orc_in_id_order(spark, tmp_path):
    from pyarrow import orc

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_orc.write_tokens(docs, P.path("byte_bpe_50k.json"), f"{tmp_path}/o", files=4)
    names = sorted(n for n in os.listdir(f"{tmp_path}/o") if n.endswith(".orc"))
    ids = [i for n in names for i in orc.ORCFile(f"{tmp_path}/o/{n}").read(columns=["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(ids) and len(ids) == 200
