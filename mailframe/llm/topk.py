"""Exact top-k search by tiled matrix products.

Candidates are packed into tiles of rows, queries into tiles too; every candidate shard meets every
query tile once, multiplies, keeps the best of each query and merges the lists of its tiles. Lists of
all shards are merged per query, first by groups of shards, then in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

TOP = 20
# A cell of the grid: so many candidates against so many queries, on average, are one task's work.
SHARD_ROWS = 4096
TILE_ROWS = 4096
# Rows of a tile that are multiplied at once.
SLAB = 512
# So many lists of a query are merged into one in each level of the tree.
FAN = 32
BEST_SCHEMA = "query_id long, shard long, vec_id long, score long"


def scaled_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): components as floor(scale * x) in double; unusable vectors are left out.

    Left out are rows without an id, null vectors and vectors with a null or non-finite component.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.coalesce(
        ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False)
    )
    floored = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    return embeddings.where(usable & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), floored.alias("v")
    )


def _inner(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer products: in the narrowest type whose every partial sum is exact."""
    dim = min(queries.shape[1], shard.shape[1])
    queries, shard = queries[:, :dim], shard[:, :dim]
    longest = lambda a: float(np.sqrt((a * a).sum(axis=1).max(initial=0.0)))
    bound = longest(queries) * longest(shard)
    if bound < 2**23:
        return queries.astype(np.float32) @ shard.astype(np.float32).T
    if bound < 2**52:
        return queries @ shard.T
    return queries.astype(np.int64) @ shard.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the k best (id, score), ties to smaller ids; ids must rise along the columns."""
    out = []
    for row, mine in zip(scores, own, strict=True):
        keep = np.flatnonzero(ids != mine)
        values = row[keep]
        if len(values) > k:
            # All rows at or above the k-th score, so that ties are decided by id alone.
            least = np.partition(values, len(values) - k)[len(values) - k]
            at = np.flatnonzero(values >= least)
            keep, values = keep[at], values[at]
        order = np.lexsort((ids[keep], -values))[:k]
        out.append((ids[keep][order], values[order].astype(np.int64)))
    return out


def _cell(k: int):
    """Products of one query tile and one shard, reduced to the best k of each query."""
    schema = pa.schema([(name, pa.int64()) for name in ("query_id", "shard", "vec_id", "score")])

    def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.sort_by("vec_id").combine_chunks()
        lists = rows["v"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.zeros((len(sizes), int(sizes.max(initial=0))))
        data[np.arange(data.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return rows["vec_id"].to_numpy(), data

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        asked = rows["asks"]
        q_ids, q = matrix(rows.filter(asked))
        c_ids, c = matrix(rows.filter(pc.invert(asked)))
        shard = key[0].as_py()
        parts = [schema.empty_table()]
        for start in range(0, len(q_ids), SLAB):
            ids = q_ids[start : start + SLAB]
            best = _best(_inner(q[start : start + SLAB], c), c_ids, ids, k)
            lengths = [len(b[0]) for b in best]
            columns = [
                np.repeat(ids, lengths), np.full(sum(lengths), shard, np.int64),
                np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best]),
            ]
            parts.append(pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=schema))
        return pa.concat_tables(parts)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    Both inputs are (vec_id long, v array<double> of whole numbers). A query never meets rows of its
    own id. Ties go to the smaller id. Vectors of unequal length are multiplied as if the shorter one
    went on in zeros. Rows that repeat in both id and vector count once; ids with different vectors
    are candidates, and queries, with each of them. No vectors or no queries give no rows.
    """
    vectors = stage(vectors.dropDuplicates(["vec_id", "v"]), "top-vectors")
    queries = stage(queries.dropDuplicates(["vec_id", "v"]), "top-queries")
    shards = -(-max(vectors.count(), 1) // SHARD_ROWS)
    tiles = -(-max(queries.count(), 1) // TILE_ROWS)
    dealt = F.xxhash64("vec_id", "v")
    # The grid of tiles and shards: a row goes to the cells of its own line or column, in bulk.
    candidate = vectors.select(
        F.pmod(dealt, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"),
        F.lit(False).alias("asks"), "vec_id", "v",
    )
    asking = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(dealt, F.lit(tiles)).cast("int").alias("tile"),
        F.lit(True).alias("asks"), "vec_id", "v",
    )
    lists = candidate.unionByName(asking).groupBy("shard", "tile").applyInArrow(_cell(k), BEST_SCHEMA)
    # Lists of neighbouring shards are merged until each query has a single one.
    while shards > 1:
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("long"))
        order = Window.partitionBy("query_id", "shard").orderBy(F.col("score").desc(), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
