"""Exact top-k search by inner product.

Vectors are turned into integers and dealt to shards; queries are dealt to blocks. Every
block meets every shard in one tile, a matrix product that keeps the best k of each query.
The lists of a query are merged in a tree of fixed fan-in, so no group grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, saved, shuffle_parts

SHARD_ROWS = 16_384
BLOCK_ROWS = 2_048
FAN_IN = 16
SCALE = 256
_LONG = 2**63


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) for each component, as doubles (whole numbers)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def exact_products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """The inner products as int64, exact; beyond the range of a long they stop at its ends."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**24:
        return (queries.astype(np.float32) @ shard.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (queries @ shard.T).astype(np.int64)
    if most < _LONG:
        return queries.astype(np.int64) @ shard.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(shard).T, 1 - _LONG, _LONG - 1).astype(np.int64)


def partial_top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and scores of each row's best ``k``, ties to smaller ids, without its own id.

    ``ids`` must ascend. The k-th best score is found by partial selection; everything
    above it stays, and of its equals the first ones.
    """
    allowed = ids[None, :] != own[:, None]
    wanted = np.minimum(k, allowed.sum(1))
    low = np.iinfo(np.int64).min
    ranked = np.where(allowed, scores, low)
    take = min(k, ranked.shape[1])
    bound = np.partition(ranked, ranked.shape[1] - take, axis=1)[:, ranked.shape[1] - take]
    better = allowed & (ranked > bound[:, None])
    equal = allowed & (ranked == bound[:, None])
    rest = wanted - better.sum(1)
    kept = better | (equal & (np.cumsum(equal, axis=1) <= rest[:, None]))
    rows, at = np.nonzero(kept)
    return rows, ids[at], scores[rows, at]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    values = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False) if rows else np.zeros(0)
    return values.reshape(rows, -1) if rows else np.zeros((0, 0))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of the highest score for each query.

    A score is the exact inner product of floor(scale * x). Vectors that are null, hold a
    null or non-finite component, or have no id take no part. A vector is compared with
    vectors of its own length only. Rows that repeat an id are one candidate each, except
    to a query with that id; a repeated query id is asked once, with its smallest vector.
    Ties go to the smaller id. A query with no candidate has no row.
    """
    require(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    base = (
        vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
        .select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .withColumn("width", F.size("v"))
    )
    base = saved(base, "vectors")
    counts = base.groupBy("width").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"))
    # Shards and blocks of a width follow its rows. Widths are few: one row each.
    grid = counts.filter("q > 0").select(
        "width",
        F.greatest(F.ceil(F.col("n") / shard_rows), F.lit(shuffle_parts(spark))).cast("int").alias("shards"),
        F.ceil(F.col("q") / block_rows).cast("int").alias("blocks"),
    )
    base = base.join(grid, "width")
    queries = base.filter("asks").groupBy("width", "vec_id", "shards", "blocks").agg(F.min("v").alias("v"))
    hashed = F.xxhash64("vec_id")
    asked = queries.select(
        "width", "vec_id", "v", F.pmod(hashed, "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
    )
    held = base.select(
        "width", "vec_id", "v", F.pmod(hashed, "shards").cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "shard", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        right = right.sort_by("vec_id")
        own = left.column("query_id").to_numpy()
        ids = right.column("vec_id").to_numpy()
        q, m = _matrix(left.column("q"), left.num_rows), _matrix(right.column("v"), right.num_rows)
        shard = left.column("query_shard")[0].as_py()
        found = []
        for start in range(0, len(own), 512):
            part = slice(start, start + 512)
            rows, at, scores = partial_top(exact_products(q[part], m), ids, own[part], k)
            found.append((own[part][rows], at, scores))
        query, at, scores = (np.concatenate(x) for x in zip(*found))
        return pa.table([query, np.full(len(query), shard, np.int64), at, scores], names)

    cells, own_cells = ["width", "shard", "block"], ["query_width", "query_shard", "query_block"]
    asked = asked.select(*cells, "vec_id", "v").toDF(*own_cells, "query_id", "q")
    lists = (
        asked.groupBy(*own_cells)
        .cogroup(held.select(*cells, "vec_id", "v").groupBy(*cells))
        .applyInArrow(tile, "query_id long, shard long, vec_id long, score long")
    )
    ordered = lambda c: F.slice(F.array_sort(c), 1, k)
    tops = lists.groupBy("query_id", "shard").agg(
        ordered(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id"), "score"))).alias("top")
    )
    tops = saved(tops, "tops")
    level = grid.agg(F.max("shards")).first()[0] or 0
    while level > 1:
        # One node of the tree: at most FAN_IN lists of k, however many shards there are.
        level = -(-level // FAN_IN)
        tops = tops.groupBy("query_id", F.floor(F.col("shard") / FAN_IN).alias("shard")).agg(
            ordered(F.flatten(F.collect_list("top"))).alias("top")
        )
    rows = tops.select("query_id", F.posexplode("top").alias("at", "hit"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
