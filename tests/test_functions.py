"""Column functions compared with plain-Python models of the same rules."""

from __future__ import annotations

import fnmatch
import pathlib
import random
import re

from pyspark.sql import functions as F

from hostlens.functions import columns as C
from hostlens.functions import text as TX


def chunk_model(text, size=1500, overlap=200):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            nl = text.rfind("\n", start, end)
            if nl > start + size // 2:
                end = nl + 1
            else:
                sp = text.rfind(" ", start, end)
                if sp > start + size // 2:
                    end = sp + 1
        c = text[start:end].strip()
        if c:
            out.append(c)
        start = max(end - overlap, 0)
    return out


def _random_text(rng, n):
    alphabet = "abcdefgh é" + " " * 3 + "\n"
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_chunk_split_matches_model(spark):
    rng = random.Random(7)
    texts = [_random_text(rng, n) for n in [0, 5, 1500, 1501, 3000, 4321, 9000]]
    texts += ["x" * 5000, ("word " * 900), ("line\n" * 700), "  padded  " * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: list(r.c) for r in df.select("id", TX.split_chunks("t").alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == chunk_model(t), i
    small = {r.id: list(r.c) for r in df.select("id", TX.split_chunks("t", 100, 20).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert small[i] == chunk_model(t, 100, 20), i
    fold = {r.id: list(r.c) for r in df.select("id", TX.split_chunks("t", method="fold").alias("c")).collect()}
    for i, t in enumerate(texts):
        assert fold[i] == chunk_model(t), i


def test_security_tags(spark):
    df = spark.createDataFrame([("SSH login then sudo -i and nc -lvp; python",), ("nothing here",)], "t string")
    got = [list(r.tags) for r in df.select(TX.security_tags("t").alias("tags")).collect()]
    assert got == [["lateral_movement", "privilege_escalation", "exfiltration", "execution"], []]


def test_glob_matches_fnmatch():
    rng = random.Random(3)
    patterns = ["*.log", "/tmp/*", "a?c", "[!a]*", "[a-c]x*", "*/.cache/*", "f[!0-4]*_[1-3]", "x[]]y", "[!]]z"]
    names = ["a.log", "/tmp/x/y", "abc", "bbc", "cx1", "/home/u/.cache/z", "f5_1", "f1_2", "x]y", "az", "]z", "bz"]
    names += ["".join(rng.choice("abc/.x]_15") for _ in range(rng.randint(0, 6))) for _ in range(200)]
    for p in patterns:
        rx = re.compile(C.glob_to_regex(p))
        for n in names:
            assert bool(rx.match(n)) == fnmatch.fnmatchcase(n, p), (p, n)


def test_path_parts_match_pathlib(spark):
    paths = ["a", "/a", "/a/b/", "a/b", "", "/usr/bin/ls", "/x/y/z.txt", "rel/dir/"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select("p", C.base_name("p").alias("n"), C.parent_dir("p").alias("d")).collect()
    for r in got:
        assert r.n == pathlib.PurePosixPath(r.p).name, r.p
        assert r.d == str(pathlib.PurePosixPath(r.p).parent), r.p


def addr_model(s):
    if not s or s == "*:*":
        return ("*", 0)
    if s.startswith("["):
        m = re.match(r"\[([^\]]+)\]:(\d+)", s)
        if m:
            return (m.group(1), int(m.group(2)))
    if ":" in s:
        a, p = s.rsplit(":", 1)
        return (a, int(p) if p.isdigit() else 0)
    return (s, 0)


def test_address_split_matches_model(spark):
    vals = ["", "*:*", "[::1]:22", "[::1]:22x", ":::22", "0.0.0.0:*", "1.2.3.4:80", "[::1]:*", "abc", "a:b:c:9"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    for r in df.select("v", C.addr_port_text("v").alias("a")).collect():
        assert (r.a.address, r.a.port) == addr_model(r.v), r.v


def test_strip_and_split_match_python(spark):
    vals = ["  a  b\tc ", " x y　", "", "   ", "\x1cq\x1f"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = df.select("v", C.py_strip("v").alias("s"), C.py_split_ws(C.py_strip("v")).alias("p")).collect()
    for r in got:
        assert r.s == r.v.strip()
        assert list(r.p) == r.v.split()


def test_fill_prints_none(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert df.select(C.fill("x={a} y={b}", a="a", b="b").alias("s")).first().s == "x=1 y=None"


def test_exe_name(spark):
    df = spark.createDataFrame([("/usr/bin/python3 -c x",), ("nc -l",), ("",), ("  ",)], "c string")
    assert [r.e for r in df.select(C.exe_name("c").alias("e")).collect()] == ["python3", "nc", "", ""]
