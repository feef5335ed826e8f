"""Archive and directory scans of artifact collections.

Archives are the unit of parallelism: ``binaryFile`` lists them, a
``mapInPandas`` step unpacks each archive on an executor into member rows,
and everything after that (categorising, line splitting, parsing) is Column
expressions.  A collection's members never pass through the driver.
"""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.columns import base_name, col_, contains_any, glob_to_regex, parent_dir

ARCHIVE_SUFFIXES = (".tar.gz", ".tgz", ".tar", ".zip", ".gz")

MEMBER_SCHEMA = T.StructType([
    T.StructField("archive_path", T.StringType()),
    T.StructField("collection_id", T.StringType()),
    T.StructField("relative_path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("is_directory", T.BooleanType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("error", T.StringType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("first_line", T.LongType()),
])

# A member's bytes come in parts of about this size, cut after a line end, so a
# member of any size is read whole in bounded cells.  YAML members are documents
# and stay in one part.
PART_BYTES = 32 * 1024 * 1024


ARCHIVE_SUFFIXES = (".tar.gz", ".tgz", ".tar", ".zip", ".gz")


def collection_id_of(archive_path: str, root: str = "") -> str:
    """Collection id of an archive: its path below ``root`` without the suffix, so that archives of one
    name in different folders stay apart (folders joined by ``__``)."""
    path, root = (re.sub(r"^file:/*", "/", x.rstrip("/")) for x in (archive_path, root))
    name = path[len(root):].strip("/") if root and path.startswith(root + "/") else posixpath.basename(path)
    for suf in ARCHIVE_SUFFIXES:
        if name.lower().endswith(suf):
            name = name[: -len(suf)]
            break
    return name.replace("/", "__")


def _safe_member(name: str) -> bool:
    return not name.startswith("/") and ".." not in name


def _parts(stream, whole: bool) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, part, number of its first line) of a member, cut after line ends."""
    part, line, rest = 0, 0, b""
    while True:
        data = stream.read(-1 if whole else PART_BYTES)
        block = rest + data
        cut = len(block) if whole or not data else block.rfind(b"\n") + 1
        if cut or (not data and not part):
            yield block[:cut], part, line
            line += block.count(b"\n", 0, cut)
            part += 1
        rest = block[cut:]
        if whole or not data:
            return


def _unpack(path: str, data: bytes, cid: str) -> Iterator[tuple]:
    """Members read so far, then a row with ``error`` where an archive or a member cannot be read on."""
    def member(name, size, is_dir, open_):
        name = name.rstrip("/")
        if is_dir:
            yield (path, cid, name, size, True, None, None, 0, 0)
            return
        part = 0
        try:
            stream = open_()
            whole = name.lower().endswith((".yaml", ".yml"))
            for block, part, line in _parts(stream, whole) if stream is not None else ():
                yield (path, cid, name, size, False, block, None, part, line)
        except Exception as exc:  # the rest of this member is lost, the archive goes on
            yield (path, cid, name, size, False, None, f"read failed: {exc}", part, None)

    try:
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as zf:
                for info in zf.infolist():
                    if _safe_member(info.filename):
                        yield from member(info.filename, int(info.file_size), info.is_dir(), lambda i=info: zf.open(i))
            return
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tf:
            for m in tf:
                if _safe_member(m.name) and (m.isfile() or m.isdir()):
                    yield from member(m.name, int(m.size), m.isdir(), lambda m=m: tf.extractfile(m))
    except Exception as exc:  # truncated or not an archive: what came before stays
        yield (path, cid, None, None, None, None, f"archive cannot be read on: {exc}", None, None)


# Output Arrow batches are cut by bytes as well as rows, so one archive with
# many large members never forms a single huge batch in the Python worker.
BATCH_MAX_ROWS = 256
BATCH_MAX_BYTES = 64 * 1024 * 1024


def _unpack_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [f.name for f in MEMBER_SCHEMA.fields]

    def frame(rows):
        return pd.DataFrame(rows, columns=cols).astype({"size": "Int64", "part": "Int32", "first_line": "Int64", "is_directory": "boolean"})

    for pdf in batches:
        rows, size = [], 0
        for path, data, cid in zip(pdf["path"], pdf["content"], pdf["cid"]):
            for row in _unpack(path, bytes(data), cid):
                rows.append(row)
                size += len(row[5]) if row[5] is not None else 0
                if len(rows) >= BATCH_MAX_ROWS or size >= BATCH_MAX_BYTES:
                    yield frame(rows)
                    rows, size = [], 0
        if rows:
            yield frame(rows)


def scan_archives(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC-1 / SRC-24: archive members of every archive under ``path``.

    One task per archive file (``binaryFile`` keeps each file whole); members
    come out as rows with their bytes, long ones in several parts.  Members with
    absolute paths or '..' are skipped.  A member that cannot be read keeps a row
    with ``error``; an archive that cannot be read (on) keeps one without a path,
    after the members before the damage (see ``archive_errors``).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    files = files.where(F.lower("path").rlike(r"\.(tar\.gz|tgz|tar|zip|gz)$"))
    root = re.sub(r"^file:/*", "/", path.rstrip("/"))
    plain = F.regexp_replace("path", "^file:/*", "/")
    below = F.when(plain.startswith(root + "/"), F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(root) + 2})")
                   ).otherwise(F.substring_index(plain, "/", -1))
    cid = F.regexp_replace(F.regexp_replace(below, r"(?i)\.(tar\.gz|tgz|tar|zip|gz)$", ""), "/", "__")
    return files.select("path", "content", cid.alias("cid")).mapInPandas(_unpack_batches, MEMBER_SCHEMA)


def archive_errors(members: DataFrame) -> DataFrame:
    """Archives and members that could not be read, in whole or in part."""
    return members.where(F.col("error").isNotNull()).select("archive_path", "collection_id", "relative_path", "part", "error")


def scan_directory(spark: SparkSession, root: str, collection_id: str | None = None) -> DataFrame:
    """SRC-2: files of an unpacked collection folder as member rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^" + _re_escape(prefix), "")
    cid = F.lit(collection_id or collection_id_of(root))
    return files.select(
        F.lit(root).alias("archive_path"), cid.alias("collection_id"), rel.alias("relative_path"),
        F.col("length").alias("size"), F.lit(False).alias("is_directory"), "content",
        F.lit(None).cast("string").alias("error"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("first_line"))


def _re_escape(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "/" else c for c in text)


# ---------------------------------------------------------------------------
# SRC-4 categoriser
# ---------------------------------------------------------------------------
def categorize_path(path) -> Column:
    """Category of an archive member path; first matching rule wins.

    bodyfile -> live_response -> hash -> logs -> YAML under files/ (logs if
    its path has a log word, else live_response) -> config -> unknown.
    """
    low = F.lower(col_(path))
    is_yaml = low.endswith(".yaml") | low.endswith(".yml")
    expr = F.when(contains_any(low, rules.BODYFILE_PATH_MARKERS), F.lit("bodyfile"))
    for cat, markers in rules.categorizer_rules()[1:]:
        expr = expr.when(contains_any(low, markers), F.lit(cat))
    files_yaml = low.contains("files/") & is_yaml
    expr = expr.when(files_yaml & contains_any(low, rules.FILES_YAML_LOG_WORDS), F.lit("logs"))
    expr = expr.when(files_yaml, F.lit("live_response"))
    expr = expr.when(contains_any(low, rules.CONFIG_PATH_MARKERS), F.lit("config"))
    return expr.otherwise(F.lit("unknown"))


def live_kind(path) -> Column:
    """SRC-8: parser for a live-response file, from its lower-cased file name."""
    name = F.lower(base_name(col_(path)))
    return (
        F.when(name.endswith(".yaml") | name.endswith(".yml"), F.lit("yaml"))
        .when(name.contains("ps_") | name.startswith("ps"),
              F.when(name.contains("aux"), F.lit("ps_aux")).when(name.contains("ef"), F.lit("ps_ef"))
              .otherwise(F.lit("ps_generic")))
        .when(name.contains("netstat") | name.contains("ss_"), F.lit("netstat"))
        .when(name.contains("passwd") | name.contains("user"), F.lit("passwd"))
        .otherwise(F.lit("raw"))
    )


def catalog_members(members: DataFrame) -> DataFrame:
    """``artifact_files``: members with file name, parent, category and parser kind (a row per part)."""
    rp = F.col("relative_path")
    return members.where(rp.isNotNull()).select(
        "*",
        base_name(rp).alias("filename"),
        parent_dir(rp).alias("parent_dir"),
        categorize_path(rp).alias("category"),
        F.when(categorize_path(rp) == "live_response", live_kind(rp)).alias("live_kind"),
    )


def _listed(files: DataFrame) -> DataFrame:
    """One row per file."""
    files = files.where(~F.col("is_directory"))
    return files.where(F.col("part") == 0) if "part" in files.columns else files


def filter_members(files: DataFrame, category: str | None = None, pattern: str | None = None) -> DataFrame:
    """SRC-2 listing: optional category and file-name glob (applied to all categories)."""
    out = _listed(files)
    if category:
        out = out.where(F.col("category") == category)
    if pattern:
        out = out.where(F.col("filename").rlike(glob_to_regex(pattern)))
    return out


def inventory_totals(files: DataFrame) -> DataFrame:
    """SRC-6: file count and bytes per collection (directories excluded)."""
    return _listed(files).groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def artifact_paths(files: DataFrame) -> DataFrame:
    """SRC-23: member paths by (collection, category), as sorted rows.

    Kept as rows rather than one list per kind, so an archive with millions of
    members never becomes a single array cell.
    """
    return (_listed(files).select("collection_id", "category", "relative_path")
            .orderBy("collection_id", "category", "relative_path"))


# ---------------------------------------------------------------------------
# SRC-3 lines of members
# ---------------------------------------------------------------------------
def text_of(content: Column) -> Column:
    """UTF-8 text of bytes; invalid bytes are dropped, a U+FFFD that was there stays."""
    raw, kept = content.cast("string"), "\ufdd0"  # a noncharacter stands in for it meanwhile
    fixed = F.replace(F.make_valid_utf8(F.replace(raw, F.lit("\ufffd"), F.lit(kept))), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(fixed, F.lit(kept), F.lit("\ufffd")))


def member_lines(files: DataFrame) -> DataFrame:
    """Lines of text members: UTF-8 (bad bytes dropped), split on '\\n', trailing '\\r' removed;
    ``line_no`` is 0-based within the file, over all its parts."""
    arr = F.split(text_of(F.col("content")), "\n", -1)
    # a final newline does not start another line
    arr = F.when(F.element_at(arr, -1) == "", F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0)))).otherwise(arr)
    first = F.coalesce("first_line", F.lit(0)) if "first_line" in files.columns else F.lit(0)
    exploded = files.where(F.col("content").isNotNull()).select(
        "collection_id", F.col("relative_path").alias("source_file"), first.cast("bigint").alias("_first"),
        *[c for c in ["category", "live_kind"] if c in files.columns],
        F.posexplode(arr).alias("line_no", "line"))
    return exploded.withColumn("line", F.regexp_replace("line", "\r$", "")).withColumn(
        "line_no", F.col("line_no") + F.col("_first")).drop("_first")


# ---------------------------------------------------------------------------
# SRC-5 collection metadata
# ---------------------------------------------------------------------------
COLLECTION_DIR_RE = r"^uac-(.+)-([^-]+)-([0-9]{14})"


def collections_from_members(files: DataFrame, log_lines: DataFrame | None = None) -> DataFrame:
    """One row per collection: host, OS and collection time from the top folder
    name ``uac-<host>-<os>-<yyyyMMddHHmmss>``; ``Hostname:`` / ``OS:`` lines of
    the collection log override (last line wins)."""
    top = F.regexp_extract("relative_path", r"^([^/]+)", 1)
    dirs = files.where(top.startswith("uac-")).select("collection_id", top.alias("top")).distinct()
    m = [F.regexp_extract("top", COLLECTION_DIR_RE, i) for i in (1, 2, 3)]
    parts = F.split("top", "-")
    meta = dirs.select(
        "collection_id",
        F.when(m[0] != "", m[0]).otherwise(F.get(parts, 1)).alias("dir_host"),
        F.when(m[1] != "", m[1]).otherwise(F.get(parts, 2)).alias("dir_os"),
        F.try_to_timestamp(F.when(m[2] != "", m[2]).otherwise(F.element_at(parts, -1)), F.lit("yyyyMMddHHmmss"))
        .alias("collection_time"),
    )
    # every input has a row, also without such a folder
    meta = files.select("collection_id").distinct().join(meta, "collection_id", "left").groupBy("collection_id").agg(
        F.min("dir_host").alias("dir_host"), F.min("dir_os").alias("dir_os"),
        F.min("collection_time").alias("collection_time"))
    if log_lines is None:
        return meta.select("collection_id", F.col("dir_host").alias("hostname"), F.col("dir_os").alias("os_type"),
                           "collection_time")
    low = F.lower("line")
    kv = log_lines.where(F.lower("source_file").contains("uac.log")).select(
        "collection_id", "source_file", "line_no",
        F.when(low.contains("hostname:"), F.lit("host"))
        .when(low.contains("os:") | low.contains("system:"), F.lit("os")).alias("k"),
        F.regexp_replace(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), r"^\s+|\s+$", "").alias("v"),
    ).where(F.col("k").isNotNull())
    last = kv.groupBy("collection_id").agg(
        F.max_by(F.when(F.col("k") == "host", F.col("v")), F.when(F.col("k") == "host", F.struct("source_file", "line_no"))).alias("log_host"),
        F.max_by(F.when(F.col("k") == "os", F.col("v")), F.when(F.col("k") == "os", F.struct("source_file", "line_no"))).alias("log_os"),
    )
    return meta.join(last, "collection_id", "full_outer").select(
        "collection_id",
        F.coalesce("log_host", "dir_host").alias("hostname"),
        F.coalesce("log_os", "dir_os").alias("os_type"),
        "collection_time",
    )


def read_text_lines(spark: SparkSession, path: str, glob: str | None = None,
                    collection_id: str | None = None) -> DataFrame:
    """SRC-3 for large flat files: splittable ``text`` source, one row per line.

    ``line_no`` is the line's 0-based position in its file, however the file is split: lines
    are placed within their block (``file_block_start``), and the counts of a file's earlier
    blocks, one small row each, are added.  Empty files have no lines.
    """
    reader = spark.read.format("text").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
                                   F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    blocks = raw.groupBy("source_file", "_block").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_many"))
    earlier = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source_file", "_block", "_from", F.coalesce(F.sum("_many").over(earlier), F.lit(0)).alias("_before"))
    cid = F.lit(collection_id) if collection_id else F.regexp_extract("source_file", r"/([^/]+)/[^/]*$", 1)
    return raw.join(blocks, ["source_file", "_block"]).select(cid.alias("collection_id"), "source_file",
                                                              (F.col("_at") - F.col("_from") + F.col("_before")).alias("line_no"), "line")
