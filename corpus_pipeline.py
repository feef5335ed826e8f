"""Corpus cleaning pipeline: language ID, near duplicates, repeated substrings, benchmark leaks, token ids.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
and returns the documents that it keeps, with the columns of ``documents``.  The
last returns the token ids of what is left.

1. ``language``: documents without a letter, and those whose best language gets
   under half of the probability, go.  Where no row has a label there is nothing
   to learn from, and all documents with a letter stay.
2. ``near_duplicates``: of each group of documents linked by word shingles (five
   words, similarity of at least 0.8) the one of least id stays.  Rows without
   an id join no group and stay; rows that share an id are documents of their own
   if their texts differ (of a group's, the one of least hash stays, before others).
3. ``repeated_substrings``: bytes of strings of 200 bytes that occur again
   anywhere go (a passage of 50 words has more); bytes of characters cut in two
   go with them.
4. ``benchmark``: documents in which a window of a benchmark item occurs go.
5. ``tokens``: byte-level BPE ids, decoded again to check the round trip.

Null texts, empty tables and repeated rows pass through as the operators define;
columns beyond those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm import bpe, decontaminate, langid, partenum, substring_sa
from hostlens.llm.common import gathered, listed, saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.5
SHINGLE, PERCENT = 5, 80
REPEAT_BYTES = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    network = langid.train(docs)
    if network is None:
        return docs.where(langid.has_letter(F.col("text")))
    found = langid.predict(docs, network)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    shared = saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared-ids")
    # rows of a shared id are known by a negative number of (id, text) each
    docs = docs.join(shared.withColumn("is_shared", F.lit(True)), "doc_id", "left")
    own = F.lit(-1).cast("bigint") - F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**63 - 1))
    docs = docs.select(*COLUMNS, F.when(F.col("is_shared"), own).otherwise(F.col("doc_id")).alias("key"))
    groups = saved(partenum.similar_components(docs, size=SHINGLE, percent=PERCENT, pieces=2, id_col="key"), "groups")
    keys = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("rows"), F.min("component_id").alias("least"))
    rows = groups.count()
    odd = saved(gathered(keys.where("rows > 1 or key <> least"), rows), "odd")  # not the only row of its group's least key
    # texts that are surely not among them need no shuffle
    h = F.when(F.col("key").isNotNull(), F.xxhash64("key"))
    hashes, n = odd.select(F.xxhash64("key").alias("h")), odd.count()
    some = listed(docs, h, hashes, n).join(odd.select("key", "least"), "key", "left")
    some = some.where(F.col("least").isNull() | (F.col("least") == F.col("key"))).select("key", *COLUMNS)
    one = some.groupBy("key").agg(F.min(F.struct("text", "doc_id", "lang", "source", "n_chars")).alias("x")).select("x.*")
    return listed(docs, h, hashes, n, "left_anti").select(*COLUMNS).unionByName(gathered(one.select(*COLUMNS), rows))


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_sa.remove_repeats(docs, window=REPEAT_BYTES, whole_characters=True).where("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("digest").alias("cut_digest"), F.col("kept").cast("string").alias("kept"))
    cut = cut.dropDuplicates(["cut_id", "cut_digest"])
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    both = docs.select(*COLUMNS).join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (digest == F.col("cut_digest")), "left")
    text = F.coalesce("kept", "text")
    return gathered(both, docs.count()).withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    leaks = found.select(F.col("doc_id").alias("leak_id"), "text_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.xxhash64("text") == F.col("text_hash"))
    return gathered(docs.select(*COLUMNS).join(leaks, same, "left_anti"), docs.count())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_substrings", repeated_substrings),
          ("benchmark", benchmark), ("tokens", tokens)]
ORACLE_SQL = None  # language ID is a trained network: no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
