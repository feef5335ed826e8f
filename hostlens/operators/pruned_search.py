"""RET-3 over whole tables: exact k nearest vectors, by blocks, with clusters skipped by the triangle inequality.

A bounded sample of corpus rows serves as pivots.  Every corpus vector goes to its nearest
pivot; vectors of a pivot, ordered by their distance from it, are packed into blocks that
know their least and greatest distance.  Queries are packed into blocks of neighbours, too.
For a query at distance ``d`` from a pivot no vector of a block is nearer than ``d - greatest``
or ``least - d``; the distances to the pivots, which are corpus rows, bound its k-th neighbour
from the beginning, and each scored block tightens the bound.  Pairs of blocks that the bounds
exclude are dropped by the join; those left are scored as matrix products, for the queries that
need them.  What may be among the nearest is computed again term by term, as ``squared_l2``
does, so ties and digits agree with the plain search.

Rows without a vector are never hits and have none.  Nothing but the pivots reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from .numbering import materialized

PIVOTS = 96
CORPUS_BLOCK, QUERY_BLOCK = 1024, 256
SPREAD = 8  # parts of a pivot's vectors, so that a large cluster is packed by several tasks


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, by a matrix product."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and ``b``, one to one, summed from the first component on."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = b[:, k] - a[:, k]
        out += d * d
    return out


def _slack(bound: np.ndarray, scale: float) -> np.ndarray:
    """Room for the rounding of matrix products."""
    return bound + 1e-9 * (1.0 + scale)


BLOCKS = "pivot int, least double, greatest double, ids binary, vectors binary"


def knn_blocks(corpus: DataFrame, queries: DataFrame, k: int = rules.HITS_PER_QUERY, id_col: str = "id", query_id: str = "query_id",
               vec_col: str = "embedding", pivots: int = PIVOTS, with_scored: bool = False) -> DataFrame:
    """(query_id, rank, id, distance, score) of the ``k`` nearest corpus rows of every query; ids are bigint, a tie
    goes to the lesser id.  ``with_scored`` gives (query block, corpus block) counts of scored pairs instead."""
    spark = corpus.sparkSession
    rows = corpus.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where("v is not null")
    wanted = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where("v is not null")
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # as many rows as pivots
    if not chosen:
        return spark.createDataFrame([], f"{query_id} bigint, rank int, {id_col} bigint, distance double, score double")
    dim = len(chosen[0]["v"])
    centre = np.array([r["v"] for r in chosen], np.float64)
    shared = spark.sparkContext.broadcast(centre)

    def assign(batches):
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            d = np.sqrt(_squares(v, shared.value))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]),
                                              pa.array([x.tobytes() for x in v], pa.binary())], ["id", "pivot", "r", "v"])

    placed = rows.mapInArrow(assign, "id bigint, pivot int, r double, v binary")

    def pack(most: int, finish):
        """Runs of rows of one pivot, ``most`` at a time."""
        def run(batches):
            held: list = []
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    if held and (row[1] != held[0][1] or len(held) == most):
                        yield finish(held)
                        held = []
                    held.append(row)
            if held:
                yield finish(held)

        return run

    def corpus_block(held):
        ids, _, r, v = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array([held[0][1]], pa.int32()), pa.array([min(r)]), pa.array([max(r)]), pa.array([np.array(ids).tobytes()], pa.binary()),
                                           pa.array([b"".join(v)], pa.binary())], [f.split()[0] for f in BLOCKS.split(", ")])

    order = ["pivot", F.pmod(F.xxhash64("id"), F.lit(SPREAD))]
    blocks = placed.repartition(*order).sortWithinPartitions(*order, "r").mapInArrow(pack(CORPUS_BLOCK, corpus_block), BLOCKS)
    blocks = materialized(blocks, "search-blocks")
    many = blocks.count()

    def query_block(held):
        ids, _, _, v = zip(*held)
        q = np.frombuffer(b"".join(v), np.float64).reshape(-1, dim)
        d = np.sqrt(_squares(q, shared.value))
        bound = np.sort(d, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
        return pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids), q, bound)]
            + [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (d.min(axis=0), d.max(axis=0))] + [pa.array([float(bound.max())])],
            ["q_ids", "q", "bound", "nearest", "farthest", "widest"])

    # the same vectors as queries, neighbours together
    near = wanted.mapInArrow(assign, "id bigint, pivot int, r double, v binary").repartition(*order).sortWithinPartitions(*order, "r")
    asked = near.mapInArrow(pack(QUERY_BLOCK, query_block),
                            "q_ids binary, q binary, bound binary, nearest array<double>, farthest array<double>, widest double")
    salts = max(1, min(-(-many // 4), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    room = F.col("widest") + 1e-6 * (1 + F.col("widest"))
    possible = (F.element_at("nearest", F.col("pivot") + 1) - F.col("greatest") <= room) & (F.col("least") - F.element_at("farthest", F.col("pivot") + 1) <= room)
    pairs = asked.join(dealt.hint("merge"), "salt").where(possible).select("q_ids", "q", "bound", "pivot", "least", "greatest", "ids", "vectors")

    def score(batches):
        now, q_ids, q, best_d, best_id, bound, to_pivots, scored = None, None, None, None, None, None, None, 0

        def rows_out():
            found = np.isfinite(best_d)
            rank = np.broadcast_to(np.arange(1, k + 1), best_d.shape)
            if with_scored:
                return pa.RecordBatch.from_arrays([pa.array([scored], pa.int64())], ["scored"])
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, k)[found.ravel()]), pa.array(best_id[found]), pa.array(best_d[found])], ["query", "id", "distance"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids_, q_, bound_, pivot, least, greatest, c_ids, c = (batch.column(j)[i].as_py() for j in range(8))
                if ids_ != now:
                    if now is not None:
                        yield rows_out()
                    now, scored = ids_, 0
                    q_ids, q = np.frombuffer(ids_, np.int64), np.frombuffer(q_, np.float64).reshape(-1, dim)
                    bound = np.frombuffer(bound_, np.float64).copy()
                    best_d, best_id = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
                    to_pivots = np.sqrt(_squares(q, shared.value))
                d = to_pivots[:, pivot]
                need = np.flatnonzero(np.maximum(d - greatest, least - d) <= bound + 1e-6 * (1 + bound))
                if not len(need):
                    continue
                c_ids, c = np.frombuffer(c_ids, np.int64), np.frombuffer(c, np.float64).reshape(-1, dim)
                scored += len(need) * len(c)
                squares = _squares(q[need], c)
                scale = float(max((q[need] ** 2).sum(axis=1).max(), (c ** 2).sum(axis=1).max()))
                # the k-th so far, or of this block, or by the pivots: nothing farther is wanted
                own = np.partition(squares, k - 1, axis=1)[:, k - 1] if len(c) >= k else np.full(len(need), np.inf)
                limit = np.minimum(np.minimum(own, best_d[need, -1]), bound[need] ** 2)
                at, col = np.nonzero(squares <= _slack(limit, scale)[:, None])
                exact = _exact(q[need[at]], c[col])
                every_d = np.concatenate([best_d[need].ravel(), exact])
                every_id = np.concatenate([best_id[need].ravel(), c_ids[col]])
                who = np.concatenate([np.repeat(np.arange(len(need)), k), at])
                place = np.lexsort((every_id, every_d, who))
                first = np.searchsorted(who[place], np.arange(len(need)))
                take = place[first[:, None] + np.arange(k)]
                best_d[need], best_id[need] = every_d[take], every_id[take]
                bound[need] = np.minimum(bound[need], np.sqrt(best_d[need, -1]))
        if now is not None:
            yield rows_out()

    if with_scored:
        return pairs.mapInArrow(score, "scored bigint")
    some = pairs.mapInArrow(score, "query bigint, id bigint, distance double")
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return top.select(F.col("query").alias(query_id), "rank", F.col("id").alias(id_col), "distance", F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("score"))
