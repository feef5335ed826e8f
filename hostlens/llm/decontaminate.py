"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every ``window`` consecutive words of an item (all of a shorter item) must be
found whole in a document.  Windows and documents are sets of positioned
shingles of ``shingle`` words.  A window can only occur where each of its
shingles does, so one shingle is a sufficient prefix; the shingles are ordered
by rarity in the documents and the rarest is taken.

1. One pass over the texts keeps, per document, the positions whose shingle may
   be an item's (two probes into a bit table of bounded size), with the words
   around them.
2. These hits give the exact frequency of every item shingle, hence the prefix.
3. Hits on prefix shingles are joined with their windows; positional and length
   bounds cut those that would start before or end after the text; the words
   around the hit are compared with the window's.

Only hits are shuffled, never texts.  The window side is broadcast when it has
at most ``BROADCAST_ROWS`` rows and joined by shuffle beyond.

Defined results: null or empty texts have no words and no hits; items without
words match nothing; repeated items count once per item id, also for equal
texts of different ids; repeated document rows each give a row; null ids are
kept; further columns, also of clashing names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_table, gathered, may_contain, saved, table_bits

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 100_000
MOST_BITS = 1 << 24  # 2 MB


def word_list(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; empty for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.filter(F.split(low, BETWEEN_WORDS), lambda w: w != "")


def _shingle(hashes: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])


def _windows(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(win, len) distinct windows, and (win, item_id) pairs; ``win`` is the list of words."""
    words = items.select(F.col(id_col).alias("item_id"), word_list(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    at = words.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("i"))
    pairs = at.select("item_id", F.slice("w", F.col("i") + 1, window).alias("win")).distinct()
    return pairs.select("win").distinct(), pairs


def _hits(size: int, table: Column, bits: int, reach: int) -> Column:
    """(pos, h, words around) where the shingle of ``size`` words may be an item's.  Needs columns w, hs, n."""
    shingles = f"s{size}"

    return F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - size), lambda i: may_contain(table, F.get(shingles, i), bits)), lambda i: F.struct(
        i.alias("pos"), F.lit(size).alias("size"), F.get(shingles, i).alias("h"),
        F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + size).alias("around")))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated; the hit ``spans`` (start, end;
    in words) and ``items`` (sorted ids as strings) themselves; and ``text_hash``, the text's xxhash64."""
    spark = docs.sparkSession
    wins, pairs = _windows(items, item_col, item_text_col, window)
    pairs = saved(gathered(pairs, items.count()), "windows")  # the benchmark's windows: small beside the documents
    wins = pairs.select("win").distinct()
    shingles = wins.select("win", F.least(F.size("win"), F.lit(shingle)).alias("size"), F.transform("win", lambda w: F.xxhash64(w)).alias("hs"))
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # at most ``shingle`` numbers
    parts = [shingles.where(F.col("size") == q).select(
        "win", "size", F.explode(F.transform(F.sequence(F.lit(0), F.size("win") - q), lambda i: F.struct(
            i.alias("off"), _shingle(F.col("hs"), i, q).alias("h")))).alias("x")).select("win", "size", "x.off", "x.h") for q in sizes]

    # 1. one pass over the texts
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       word_list(F.col(text_col)).alias("w"))
    base = base.select("row", "doc_id", "text_hash", "w", F.size("w").cast("bigint").alias("n_words"), F.size("w").alias("n"),
                       F.transform("w", lambda w: F.xxhash64(w)).alias("hs"))
    found = []
    for q, part in zip(sizes, parts):
        distinct = part.select("h").distinct()
        bits = table_bits(distinct.count(), MOST_BITS)
        table = bit_table(distinct, bits)
        base = base.withColumn(f"s{q}", F.transform("hs", lambda h, i: _shingle(F.col("hs"), i, q)))
        found.append(F.when(F.col("n") >= q, _hits(q, table, bits, window)))
    empty = F.array().cast("array<struct<pos:int,size:int,h:bigint,around:array<string>>>")
    hits = F.concat(*[F.coalesce(f, empty) for f in found]) if found else empty
    base = saved(base.select("row", "doc_id", "text_hash", "n_words", hits.alias("hits")), "hits")

    # 2. the rarest shingle of each window, by its frequency in the documents
    hit = base.select("row", "n_words", F.explode("hits").alias("x")).select("row", "n_words", "x.*")
    counts = hit.groupBy("size", "h").agg(F.count("*").alias("freq"))
    if parts:
        tokens = parts[0]
        for p in parts[1:]:
            tokens = tokens.unionByName(p)
        ranked = tokens.join(counts, ["size", "h"], "left").groupBy("win").agg(
            F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "size", "h")).alias("p"))
        prefix = ranked.where("p.freq > 0").select("win", F.col("p.off").alias("off"), F.col("p.size").alias("size"), F.col("p.h").alias("h"))
        prefix = saved(gathered(prefix, pairs.count()), "prefix")
    else:
        prefix = spark.createDataFrame([], "win array<string>, off int, size int, h bigint")

    # 3. join on the prefix; bounds, then the words themselves
    side = F.broadcast(prefix) if prefix.count() <= BROADCAST_ROWS else prefix
    start, first = F.col("pos") - F.col("off"), F.greatest(F.col("pos") - window, F.lit(0))
    near = hit.join(side, ["size", "h"]).where((start >= 0) & (start + F.size("win") <= F.col("n_words")))
    match = (near.where(F.slice("around", start - first + 1, F.size("win")) == F.col("win"))
             .select("row", start.alias("start"), (start + F.size("win")).alias("end"), "win"))
    match = saved(gathered(match, base.count()), "matches")
    spans = match.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("raw"))
    merged = F.aggregate(
        "raw", F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]), F.concat(
            F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(
                F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))))
    spans = spans.select("row", merged.alias("spans"))
    texts = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    names = (match.select("row", "win").distinct().join(F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs, "win")
             .select("row", texts.alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")))
    none = F.array().cast("array<string>")
    out = base.drop("hits").join(spans, "row", "left").join(names, "row", "left")
    out = out.select("doc_id", "text_hash", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
                     F.coalesce("items", none).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "items", "text_hash")
