"""Vector retrieval over chunk tables: exact top-k, context packing, multi-query merge.

Search is *scoped*: every query carries a scope value (a collection id, an
artifact type, a label...) and is compared only with corpus rows of that
scope, so the plan is an equi-join on the scope, never a cross product.  The
top-k per query is a ``row_number() <= k`` filter, which Spark turns into a
partial per-task top-k before the shuffle (window group limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import fill, token_estimate


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equal-length numeric arrays (double sum)."""
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0).cast("double"), lambda acc, v: acc + v * v)


def centroids(vectors: DataFrame, keys: list[str], vec_col: str = "embedding") -> DataFrame:
    """Mean vector per key group (partial aggregation per (key, dimension))."""
    exploded = vectors.select(*keys, F.posexplode(vec_col).alias("_pos", "_v"))
    per_dim = exploded.groupBy(*keys, "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return per_dim.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda x: x["_m"]).alias(vec_col))


CORPUS_SALTS = 16


def knn(corpus: DataFrame, queries: DataFrame, scope: str, k: int = rules.HITS_PER_QUERY,
        id_col: str = "id", vec_col: str = "embedding", query_cols: list[str] | None = None) -> DataFrame:
    """RET-3: exact k nearest corpus rows per query within the same ``scope``.

    Distance is squared L2 (the store's default metric); ``score`` is
    ``max(0, 1 - distance)``.  Ties break on the corpus id.  ``query_cols``
    identify a query (default: every query column but the vector).

    The corpus is dealt by (scope, salt of its id), so a large scope is searched
    by many tasks, each with a copy of the scope's queries; the top k of each
    salt are merged.  The corpus is never the broadcast side.
    """
    qcols = query_cols or [c for c in queries.columns if c not in (vec_col,)]
    salts = F.sequence(F.lit(0), F.lit(CORPUS_SALTS - 1))
    q = queries.select(*qcols, F.col(vec_col).alias("_q"), F.explode(salts).alias("_salt"))
    salt = F.pmod(F.xxhash64(id_col), F.lit(CORPUS_SALTS)).cast("int")
    c = corpus.select(scope, id_col, F.col(vec_col).alias("_c"), salt.alias("_salt")).hint("merge")
    j = c.join(q, [scope, "_salt"])
    scored = j.select(*qcols, "_salt", id_col, squared_l2(F.col("_c"), F.col("_q")).alias("distance"))
    part = Window.partitionBy(*qcols, "_salt").orderBy("distance", id_col)
    some = scored.withColumn("_near", F.row_number().over(part)).where(F.col("_near") <= k).drop("_near", "_salt")
    w = Window.partitionBy(*qcols).orderBy("distance", id_col)
    top = some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance")))


def pack_context(hits: DataFrame, query_cols: list[str], text_col: str, source_col: str, type_col: str,
                 order_cols: list, budget: int = rules.CONTEXT_TOKEN_BUDGET) -> DataFrame:
    """RET-4 / WIN-2: per query, take hits in order while the running token
    estimate stays within ``budget`` (stops at the first overflow), and join
    them into one context text with a source header per hit.

    The group per query is bounded by the retrieval depth, so the ordered
    collect is small.  ``order_cols`` may hold descending sort columns.
    """
    order = Window.partitionBy(*query_cols).orderBy(*order_cols)
    t = (hits.withColumn("_tok", token_estimate(text_col))
         .withColumn("_pos", F.row_number().over(order))
         .withColumn("_run", F.sum("_tok").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    kept = t.where(F.col("_run") <= budget)
    score2 = F.col("score").cast("decimal(20,4)").cast("decimal(20,2)").cast("string")
    header = fill(rules.FORMATS["context_header"], source=F.coalesce(F.col(source_col), F.lit("unknown")),
                  artifact_type=F.coalesce(F.col(type_col), F.lit("unknown")), score=score2)
    part = F.concat(header, F.col(text_col), F.lit("\n"))
    agg = kept.groupBy(*query_cols).agg(
        F.count(F.lit(1)).alias("n_used"), F.sum("_tok").alias("tokens_used"),
        F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("o"), part.alias("p")))).alias("_parts"))
    return agg.select(*query_cols, "n_used", "tokens_used",
                      F.array_join(F.transform("_parts", lambda x: x["p"]), "\n").alias("context"))


def dedup_hits(hits: DataFrame, group_cols: list[str], text_col: str, order_cols: list) -> DataFrame:
    """SET-3: drop hits whose text md5 was already seen earlier in the group (first hit wins)."""
    w = Window.partitionBy(*group_cols, F.md5(F.col(text_col))).orderBy(*order_cols)
    return hits.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


def filter_metadata(chunks: DataFrame, **equals) -> DataFrame:
    """FIL-14: equality filter on chunk metadata columns before the search."""
    out = chunks
    for k, v in equals.items():
        out = out.where(F.col(k) == F.lit(v))
    return out


def filter_tags(chunks: DataFrame, tags: list[str], mode: str = "first") -> DataFrame:
    """FIL-15: tag filter; ``first`` uses only the first tag (reference rule), ``any`` any tag."""
    if not tags:
        return chunks
    if mode == "first":
        return chunks.where(F.array_contains("tags", tags[0]))
    return chunks.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


def hashing_embeddings(df: DataFrame, text_col: str, out_col: str = "embedding", num_features: int = 256):
    """RET-2 built-in embedding: tokenise, hash term frequencies, IDF-weight, L2-normalise.

    Uses ``pyspark.ml`` stages (JVM); the IDF fit is one aggregate pass over
    the corpus.  Returns (frame with ``out_col`` as array<double>, fitted model).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_norm", p=2.0),
    ])
    model = pipe.fit(df)
    out = model.transform(df).withColumn(out_col, vector_to_array("_norm")).drop("_tokens", "_tf", "_tfidf", "_norm")
    return out, model


def embed_with(df: DataFrame, text_col: str, embed_fn, dim: int, out_col: str = "embedding") -> DataFrame:
    """RET-2 pluggable embedding: ``embed_fn(list[str]) -> list[list[float]]`` run on
    Arrow batches inside executors (``mapInPandas``)."""
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            vecs = embed_fn(pdf[text_col].fillna("").tolist())
            pdf = pdf.copy()
            pdf[out_col] = pd.Series([list(map(float, v)) for v in vecs], index=pdf.index)
            yield pdf

    return df.mapInPandas(run, schema)


def write_store(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """RET-1: add chunk rows (with their embedding column) to a Parquet store
    partitioned by collection; a failed task is retried by Spark, never lost."""
    chunks.write.mode(mode).partitionBy("collection_id").parquet(path)


def store_count(spark, path: str) -> int:
    """RET-6: number of stored chunks (a metadata-light count over the store); 0 when empty."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path).count()
    except AnalysisException:  # an emptied store holds no data files
        return 0


def clear_store(spark, path: str, schema) -> None:
    """RET-6: empty the store (overwrite with no rows, schema kept)."""
    spark.createDataFrame([], schema).write.mode("overwrite").partitionBy("collection_id").parquet(path)


def approx_knn(corpus: DataFrame, queries: DataFrame, scope: str, k: int = rules.HITS_PER_QUERY,
               id_col: str = "id", query_id: str = "query_id", vec_col: str = "embedding",
               bucket_length: float = 2.0, num_tables: int = 4, max_distance: float = 4.0) -> DataFrame:
    """RET-3 approximate mode: Euclidean LSH candidates, then exact distance and top-k.

    ``BucketedRandomProjectionLSH.approxSimilarityJoin`` joins on hash buckets
    (an equi-join per hash table), so candidates are pairs that share a bucket
    and lie within ``max_distance`` -- never the full cross product.  Recall
    depends on ``bucket_length`` / ``num_tables``; use ``knn`` when exact
    results are required.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    c = corpus.select(scope, id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    q = queries.select(F.col(scope).alias("_qscope"), query_id, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket_length,
                                        numHashTables=num_tables, seed=7).fit(c)
    pairs = model.approxSimilarityJoin(c, q, max_distance, distCol="_d")
    cand = pairs.select(F.col(f"datasetA.{scope}").alias(scope), F.col(f"datasetA.{id_col}").alias(id_col),
                        F.col(f"datasetB._qscope").alias("_qscope"), F.col(f"datasetB.{query_id}").alias(query_id),
                        (F.col("_d") * F.col("_d")).alias("distance")).where(F.col(scope) == F.col("_qscope"))
    w = Window.partitionBy(scope, query_id).orderBy("distance", id_col)
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_qscope")
    return top.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance")))
