"""Exact top-k search by tiled matrix products.

Queries and candidates are dealt by hashed ids into tiles of about `TILE` rows. Every pair of a query
tile and a candidate shard is one cell: a task gets both, multiplies them as matrices, and keeps the
k best of each query. The lists of a query are then merged in a tree: first within bundles of
shards, then across bundles. A cell is bounded whatever the tables are, and no side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.llm.store import ship_package, stored, table

K, QUERY_EVERY, SCALE = 10, 100, 1024.0
#: Rows of a tile on average, and shards whose lists are merged together at first.
TILE, BUNDLE = 4096, 64
#: Rows of queries multiplied at once within a cell.
STRIP = 256
LONG_MAX = 2**63 - 1


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k highest inner products of every query's vector.

    Candidates are all rows with another id than the query's; equal scores rank by smaller id. Rows
    with a null id, a null vector or a component that is null or not finite take no part. Only
    vectors of the same length are compared. Repeated candidate rows are candidates each; a query id
    with several vectors asks with the smallest one. Scores beyond a long stop at its limits. An
    empty table, or no other candidate, gives no rows.
    """
    usable = stored(
        vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("raw"), is_query.alias("asks"))
        .where(F.col("id").isNotNull() & F.col("raw").isNotNull())
        .where(~F.coalesce(F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)))
        .select("id", ints_of(F.col("raw")).alias("v"), F.coalesce("asks", F.lit(False)).alias("asks")),
        "vectors",
    )
    queries = usable.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    n, n_queries = usable.count(), queries.count()
    shards, tiles = max(1, -(-n // TILE)), max(1, -(-n_queries // TILE))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    tile = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(tiles)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    size = F.size("v")
    candidates = usable.select(
        F.col("id").alias("vec_id"), F.col("v").alias("w"), size.alias("length"), shard.alias("shard")
    ).withColumn("tile", every(tiles))
    asked = queries.select("id", "v", size.alias("length"), tile.alias("tile")).withColumn("shard", every(shards))
    ship_package(vectors.sparkSession)
    cell = ["tile", "shard", "length"]
    lists = (
        asked.groupBy(*cell)
        .cogroup(candidates.groupBy(*cell))
        .applyInPandas(lambda q, c: _cell(q, c, k), "query_id bigint, shard int, vec_id bigint, score bigint")
    )
    bundled = _best(lists.withColumn("bundle", F.floor(F.col("shard") / BUNDLE)), ["query_id", "bundle"], k)
    return _best(bundled, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def ints_of(vector: Column) -> Column:
    """floor(1024 * x) of each component, kept as a double (exact at any size)."""
    return F.transform(vector, lambda x: _floor(x.cast("double") * SCALE))


def _floor(x: Column) -> Column:
    """floor() without leaving doubles: beyond 2^52 every double is whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _best(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cell(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query of one cell."""
    columns = ["query_id", "shard", "vec_id", "score"]
    if queries.empty or candidates.empty:
        return pd.DataFrame({"query_id": [], "shard": [], "vec_id": [], "score": []}, dtype="int64").astype({"shard": "int32"})
    candidates = candidates.sort_values("vec_id", kind="stable")
    ids = candidates["vec_id"].to_numpy()
    right = np.stack(candidates["w"].to_list())
    parts = []
    for start in range(0, len(queries), STRIP):
        strip = queries.iloc[start : start + STRIP]
        scores = _products(np.stack(strip["v"].to_list()), right)
        for query_id, row in zip(strip["id"].to_numpy(), scores):
            best = _select(row, ids, query_id, k)
            parts.append((np.full(len(best), query_id), ids[best], row[best]))
    query_ids, vec_ids, scores = (np.concatenate(p) for p in zip(*parts))
    shard = np.full(len(vec_ids), int(candidates["shard"].iloc[0]), np.int32)
    return pd.DataFrame(dict(zip(columns, (query_ids, shard, vec_ids, scores.astype(np.int64)))))


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every sum stays whole, else in Python's integers."""
    width = max(left.shape[1], 1)
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * width
    if largest < 2.0**53:
        return left @ right.T
    whole = [[int(x) for x in row] for row in right]
    return np.array(
        [[max(-LONG_MAX - 1, min(LONG_MAX, sum(map(int.__mul__, [int(x) for x in row], other)))) for other in whole] for row in left],
        dtype=object,
    )


def _select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids (places rise with ids), without `own`."""
    others = np.flatnonzero(ids != own)
    scores = scores[others]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        chosen = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        chosen = np.arange(len(scores))
    return others[chosen]


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0)


OP1_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
"""
