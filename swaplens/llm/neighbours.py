"""Approximate nearest neighbours: Gaussian (2-stable) projections in few dimensions, indexed by kd-trees.

Vectors are brought to length 1, where the order by distance is that by cosine. Each shard of vectors keeps its projections in a
kd-tree whose leaves hold LEAF vectors. A query visits leaves by their least projected distance and verifies what they hold by
its true distance. The squared projected distance of a vector over its squared true one follows a chi-square
distribution with DIMENSIONS degrees of freedom, so the search stops as soon as the next leaf is so far that a vector beyond it is nearer than
the worst one kept with a chance below 1 - SURE.

The index is written once. Queries are taken in blocks of about BLOCK; each block is broadcast and meets every shard, and tasks keep the
nearest of each query only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaplens.llm.common import written

DIMENSIONS = 8  # of the projections
SHARD = 2_000  # vectors in one kd-tree, about
LEAF = 64
BLOCK = 4_096  # queries in one broadcast, about
SURE = 0.99  # with which the chi-square test must rule a nearer vector out
SEED = 7


@lru_cache(maxsize=8)
def projection(size: int) -> np.ndarray:
    return np.random.default_rng(SEED + size).standard_normal((size, DIMENSIONS))


@lru_cache(maxsize=8)
def quantile(sure: float) -> float:
    """Of the chi-square distribution with DIMENSIONS (even) degrees of freedom."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(DIMENSIONS // 2))
    low, high = 0.0, 400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > 1 - sure else (low, mid)
    return high


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """The rows of `points` in the leaves of a kd-tree: halves at the median of the widest dimension."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        mine = points[rows]
        order = np.argsort(mine[:, int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def nearest(queries: tuple, ids: np.ndarray, vectors: np.ndarray, k: int, best: dict[int, list], sure: float = SURE) -> int:
    """Puts the nearest of one shard into `best` (per query a heap of (score, -id)); how many vectors were verified."""
    names, asked = queries
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    points = units @ projection(vectors.shape[1])
    parts = leaves(points)
    low = np.array([points[p].min(axis=0) for p in parts])
    high = np.array([points[p].max(axis=0) for p in parts])
    ids_of, vectors_of, length_of = [ids[p] for p in parts], [vectors[p] for p in parts], [np.linalg.norm(vectors[p], axis=1) for p in parts]
    verified, limit = 0, quantile(sure)
    for name, query in zip(names.tolist(), asked):
        size = math.sqrt(float(query @ query))
        at = (query / size) @ projection(len(query))
        outside = np.maximum(low - at, 0) + np.maximum(at - high, 0)
        distance = (outside**2).sum(axis=1)
        heap = best.setdefault(name, [])
        for leaf in np.argsort(distance, kind="stable").tolist():
            if len(heap) == k and distance[leaf] > limit * max(2 - 2 * heap[0][0], 1e-12):
                break
            scores = (vectors_of[leaf] * query).sum(axis=1) / (length_of[leaf] * size)
            verified += len(scores)
            good = scores >= heap[0][0] if len(heap) == k else np.ones(len(scores), bool)
            for score, found in zip(scores[good].tolist(), ids_of[leaf][good].tolist()):
                if found != name:
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -found))
                    elif (score, -found) > heap[0]:
                        heapq.heapreplace(heap, (score, -found))
    return verified


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v array<double>, _n its size) of the rows that take part; rows of equal id are taken once, the smallest vector."""
    rows = vectors.select(vectors[id_col].cast("long").alias("_id"), vectors[vector_col].cast("array<double>").alias("_v"))
    sound = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    return rows.filter("_id IS NOT NULL AND _v IS NOT NULL").filter(sound).select("_id", "_v", F.size("_v").alias("_n"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sure: float = SURE) -> DataFrame:
    """For each vector whose id is divisible by `every`, its `k` nearest others: query_id, rank, vec_id, score (cosine).

    Vectors that are null, empty, zero or hold null or other than finite components take no part, nor do rows without id.
    Vectors meet only those of their own number of components. Ties go to the smaller id. Of rows equal in id one takes part, that of the
    smallest vector. A query with fewer others returns all of them; no rows give no rows. Further columns are not
    read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).groupBy("_id").agg(F.min("_v").alias("_v")).withColumn("_n", F.size("_v"))
    rows = written(rows, "vectors")
    counts = {r["_n"]: (r["n"], r["q"]) for r in rows.groupBy("_n").agg(F.count("*").alias("n"), F.count_if(F.col("_id") % every == 0).alias("q")).collect()}  # one row for each number of components
    shards = {n: max(1, -(-c // SHARD)) for n, (c, _) in counts.items()}
    blocks = {n: max(1, -(-q // BLOCK)) for n, (_, q) in counts.items()}
    found = []
    for n in sorted(n for n, (_, q) in counts.items() if q):
        mine = rows.filter(F.col("_n") == n)
        index = written(mine.groupBy(F.pmod(F.xxhash64("_id"), F.lit(shards[n])).alias("shard")).agg(F.collect_list(F.struct("_id", "_v")).alias("rows")), "index")  # about SHARD vectors each
        for b in range(blocks[n]):
            asked = mine.filter(F.col("_id") % every == 0).filter(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks[n])) == b).orderBy("_id").collect()  # about BLOCK
            if asked:
                block = spark.sparkContext.broadcast((np.array([r["_id"] for r in asked]), np.array([r["_v"] for r in asked], np.float64)))
                found.append(index.mapInArrow(_searched(block, k, sure), "query_id long, vec_id long, score double"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = reduce(DataFrame.union, found)
    top = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "t.vec_id", (-F.col("t.s")).alias("score"))


def _searched(block, k: int, sure: float):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            for shard in batch.column(1):
                inner = shard.values
                ids = inner.field("_id").to_numpy(zero_copy_only=False)
                vectors = inner.field("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                nearest(block.value, ids, vectors, k, best, sure)
        out = [(q, -i, s) for q, heap in best.items() for s, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return searched
