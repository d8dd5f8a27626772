"""Reproducible row samples.

Rows are ordered by a hash of their id and the seed. The order does not depend on the
partitioning, and hashes are uniform, so the boundary of "the n smallest" is found from
counts per hash prefix; only the prefix at the boundary is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 4


def _hashed(df: DataFrame, seed: int, group) -> DataFrame:
    digest = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}")))
    return df.select("*", digest.alias("_hash"), group.alias("_group")).withColumn(
        "_prefix", F.substring("_hash", 1, PREFIX_DIGITS)
    )


def _take(hashed: DataFrame, quotas: DataFrame, columns) -> DataFrame:
    """The `_quota` rows of smallest hash per group. `quotas` has one row per group."""
    counts = hashed.groupBy("_group", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    limits = (
        counts.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        .join(quotas, "_group")
        .where(F.col("_before") < F.col("_quota"))
        .select(
            "_group",
            "_prefix",
            (F.col("_quota") - F.col("_before")).alias("_room"),
            (F.col("_before") + F.col("_n") <= F.col("_quota")).alias("_whole"),
        )
    )
    # At most 16**PREFIX_DIGITS rows per group.
    kept = hashed.join(F.broadcast(limits), ["_group", "_prefix"])
    whole = kept.where("_whole").select(*columns)
    order = Window.partitionBy("_group", "_prefix").orderBy("_hash", "id")
    cut = kept.where("NOT _whole").withColumn("_rn", F.row_number().over(order))
    return whole.unionByName(cut.where(F.col("_rn") <= F.col("_room")).select(*columns))


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows (all rows when there are fewer)."""
    if n <= 0:
        raise ValueError("n must be > 0")
    quotas = df.sparkSession.createDataFrame([(0, n)], "_group int, _quota long")
    return _take(_hashed(df, seed, F.lit(0)), quotas, df.columns)


def stratified_sample(df: DataFrame, total_rows: int, seed: int = 42) -> DataFrame:
    """Equal quota per horizon (remainder to the first ones), topped up from the rest.

    Returns the input when it is small enough. The group sizes, one per horizon, are read
    first; they decide the quotas.
    """
    if total_rows <= 0:
        raise ValueError("total_rows must be > 0")
    sizes = {r["horizon"]: r["count"] for r in df.groupBy("horizon").count().collect()}
    if sum(sizes.values()) <= total_rows:
        return df
    horizons = sorted(sizes)
    base, extra = divmod(total_rows, len(horizons))
    quotas = [(h, min(base + (1 if i < extra else 0), sizes[h])) for i, h in enumerate(horizons)]
    table = df.sparkSession.createDataFrame(quotas, "_group int, _quota long")
    drawn = _take(_hashed(df, seed, F.col("horizon")), table, df.columns)
    missing = total_rows - sum(q for _, q in quotas)
    if missing == 0:
        return drawn
    rest = df.join(drawn.select("id"), "id", "left_anti")
    return drawn.unionByName(sample_rows(rest, missing, seed + 91))
