"""Connected components of an edge table by alternating stars.

Every edge (a, b) has a > b. A large star links the larger neighbours of a node to the smallest
neighbour, a small star links a node and its smaller neighbours to the smallest of them; when
neither changes the edges, each node points at the smallest node of its component. Minima are
aggregated before they move, and the joins back are ones whose hot keys Spark can split. Each round
is a written table, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.store import stored


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """`node, component` for every node of `edges` (`a`, `b`); the component is its smallest node.

    Loops, repeated edges and edges in both directions are fine; edges with a null are not read.
    No edges: no rows.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    before = _state(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)), name)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _state(edges: DataFrame) -> tuple:
    """Count and order-free hashes: equal for equal sets of edges."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.expr("bit_xor(xxhash64(a, b))"),
            F.expr("bit_xor(xxhash64(b, a, 1))"),
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (
        edges.join(least, "a")
        .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .where("a <> b")
        .distinct()
    )
