"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record into WARC files on shared
storage, in order of the reversed-host URL key, and returns the captures (key,
file, offset, length).  Payloads of at least ``revisit_bytes`` that occur more
than once are stored once, with the least page id; the others become revisit
records.  ``build_index`` sorts capture lines by key into compressed blocks and
keeps one directory row per block.  ``lookup`` finds keys: a binary search over
the index files' key ranges, one over the blocks of a file, then range reads of
just those blocks; ``fetch`` range-reads the records.

Every task writes to a file name of its own and only the names of tasks that
ended well enter the saved tables, so lost executors leave at most unused files.

Defined results: null html is the empty payload; a null url has the empty key;
line breaks in a url are percent-encoded in record headers; of equal rows the
first is the response and the rest revisit it; a null page id sorts first and
is read back as null; only the three named columns are read, so further ones do
not matter; an empty table gives no captures.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, worker_cache

CAPTURES = "key string, page_id bigint, url string, file string, offset bigint, length bigint, record_type string, digest string"
DIRECTORY = "first_key string, last_key string, index_file string, offset bigint, length bigint, n_lines int"
RECORDS = ("key string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
           "payload_digest string, payload binary")
SALTS = 32
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Reversed-host sort key: ``http://www.example.org/a?b`` -> ``org,example,www)/a?b``."""
    head = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?"
    host = F.lower(F.regexp_extract(url, head, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(url, head, ""))
    return F.coalesce(F.when(host != "", key).otherwise(url), F.lit(""))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _open_new(uri: str):
    system, path = _filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)  # members are compressed one by one


def _open_old(uri: str):
    """A random-access file; the last few stay open per worker."""
    cache = worker_cache("warc_files")
    if uri not in cache:
        if len(cache) >= 64:
            cache.clear()
        system, path = _filesystem(uri)
        cache[uri] = system.open_input_file(path)
    return cache[uri]


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record_id(key, page_id, digest, nth) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {page_id} {digest} {nth}')}>"


def _record(url, date, key, page_id, nth, digest, n_bytes, payload, first) -> bytes:
    """A response record, or with ``first`` = (key, page id) a revisit of that response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if first else http + payload
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", _record_id(key, page_id, digest, nth)),
              ("WARC-Date", date), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", "" if page_id is None else page_id)]
    if first:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(first[0], first[1], digest, 0)),
                   ("X-Refers-To-Page-ID", "" if first[1] is None else first[1])]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _roles(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(key, page_id, digest) of rows whose payload occurs more than once, with the first of its group.

    The groups' firsts are pre-aggregated; the join back is salted, as one payload may make up a third of the rows."""
    small = pages.select("key", "page_id", "digest", F.octet_length("html").alias("n"))
    firsts = (small.where(F.col("n") >= revisit_bytes).groupBy("digest")
              .agg(F.min(F.struct(F.col("page_id"), F.col("key"))).alias("first"), F.count("*").alias("copies"))
              .where("copies > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = small.withColumn("salt", F.pmod(F.xxhash64("page_id", "key"), F.lit(SALTS)).cast("int"))
    return salted.join(firsts, ["digest", "salt"]).select(
        "key", "page_id", "digest", F.lit(0).alias("kind"), F.col("first.page_id").alias("first_id"),
        F.col("first.key").alias("first_key"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   revisit_bytes: int = 100, file_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z",
                   files: int | None = None) -> DataFrame:
    """Write a record per row; the captures, saved."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", "html", url_key(F.col("url")).alias("key"), F.sha2("html", 256).alias("digest"))
    # a role row sorts right before its page row, so the writer meets both in one pass and html is shuffled once
    both = rows.select("key", "page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("first_id"),
                       F.lit(None).cast("string").alias("first_key"), "url", "html").unionByName(_roles(rows, revisit_bytes))
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", F.col("page_id").asc_nulls_first(), "digest"]
    both = both.repartitionByRange(files, *order).sortWithinPartitions(*order, "kind")

    def run(batches):
        out, at, uri, last, role, nth = None, 0, "", None, None, 0
        for batch in batches:
            found = []
            for r in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                key, page_id, digest, kind, first_id, first_key, url, html = r
                this = (key, page_id, digest)
                if kind == 0:
                    last, role, nth = this, (first_key, first_id), 0
                    continue
                if this != last:
                    last, role, nth = this, None, 0
                first = role if role and (role != (key, page_id) or nth) else None
                payload = html.encode()
                data = _gzip(_record(url, date, key, page_id, nth, digest, len(payload), payload, first), 4)
                nth += 1
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    uri, at = f"{folder}/warc/{uuid.uuid4().hex}.warc.gz", 0
                    out = _open_new(uri)
                out.write(data)
                found.append((key, page_id, url, uri, at, len(data), "revisit" if first else "response", digest))
                at += len(data)
            if out is not None:
                out.flush()
            yield _batch(found, CAPTURES)
        if out is not None:
            out.close()

    return saved(both.mapInArrow(run, CAPTURES), "captures")


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


def build_index(captures: DataFrame, folder: str, block_lines: int = 1000, files: int | None = None) -> DataFrame:
    """Capture lines sorted by key in gzip blocks of ``block_lines``; the block directory, saved."""
    files = files or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", F.col("page_id").asc_nulls_first(), "file", "offset"]
    rows = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches):
        out, at, uri, lines = None, 0, f"{folder}/index/{uuid.uuid4().hex}.cdxj.gz", []

        def block():
            nonlocal out, at
            out = out or _open_new(uri)
            data = _gzip("".join(f"{k}\t{json.dumps(v)}\n" for k, v in lines).encode(), 6)
            out.write(data)
            row = (lines[0][0], lines[-1][0], uri, at, len(data), len(lines))
            at += len(data)
            lines.clear()
            return row

        for batch in batches:
            found = []
            for key, *rest in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                lines.append((json.dumps(key), rest))
                if len(lines) == block_lines:
                    found.append(block())
            yield _batch([(json.loads(a), json.loads(b), *c) for a, b, *c in found], DIRECTORY)
        if lines:
            a, b, *c = block()
            yield _batch([(json.loads(a), json.loads(b), *c)], DIRECTORY)
        if out is not None:
            out.close()

    return saved(rows.mapInArrow(run, DIRECTORY), "block-directory")


def lookup(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """Captures (key, page_id, file, offset, length) of the distinct keys in column ``key``."""
    # the first level: one (file, first, last) row per index file
    ranges = sorted(((r["a"].encode(), r["b"].encode(), r["index_file"]) for r in directory.groupBy("index_file").agg(
        F.min("first_key").alias("a"), F.max("last_key").alias("b")).collect()), key=lambda r: r[:2])
    firsts, lasts = [r[0] for r in ranges], [r[1] for r in ranges]

    def to_files(batches):
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                raw = key.encode()
                for i in range(bisect.bisect_left(lasts, raw), bisect.bisect_right(firsts, raw)):
                    found.append((ranges[i][2], key))
            yield _batch(found, "index_file string, key string")

    asked = keys.select("key").where("key is not null").distinct().mapInArrow(to_files, "index_file string, key string")

    def search(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("offset")
        first, last = [k.encode() for k in blocks["first_key"]], [k.encode() for k in blocks["last_key"]]
        wanted = sorted({k.encode() for k in asked["key"]})
        found, need = [], sorted({i for k in wanted for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k))})
        for i in need:
            b = blocks.iloc[i]
            text = zlib.decompress(_open_old(b["index_file"]).read_at(int(b["length"]), int(b["offset"])), 31).decode()
            lines = [line.split("\t") for line in text.splitlines()]
            keys = [json.loads(k).encode() for k, _ in lines]
            for k in wanted[bisect.bisect_left(wanted, first[i]):bisect.bisect_right(wanted, last[i])]:
                for j in range(bisect.bisect_left(keys, k), bisect.bisect_right(keys, k)):
                    found.append((k.decode(), *json.loads(lines[j][1])))
        out = pd.DataFrame(found, columns=["key", "page_id", "file", "offset", "length"])
        return out.astype({"page_id": "Int64", "offset": "int64", "length": "int64"})

    return (asked.groupBy("index_file").cogroup(directory.groupBy("index_file"))
            .applyInPandas(search, "key string, page_id bigint, file string, offset bigint, length bigint"))


def _parse(data: bytes) -> tuple:
    raw = zlib.decompress(data, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return fields, int(sent["Content-Length"]), payload


def fetch(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of captures, range-read from the archives and checked against their digest."""
    import hashlib

    def number(text):
        return int(text) if text else None

    def run(batches):
        for batch in batches:
            found, size = [], 0
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))):
                fields, n_bytes, payload = _parse(_open_old(file).read_at(length, offset))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "response" and (len(payload) != n_bytes or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged record in {file} at {offset}")
                found.append((key, number(fields["X-Page-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"],
                              number(fields.get("X-Refers-To-Page-ID")), n_bytes, digest, payload if with_payload else None))
                size += len(payload) if with_payload else 0
                if size > 32 << 20:
                    yield _batch(found, RECORDS)
                    found, size = [], 0
            yield _batch(found, RECORDS)

    return captures.mapInArrow(run, RECORDS)
