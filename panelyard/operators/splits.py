"""Cuts of the panel by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.contract import FOLD_MIN_TRAIN, FOLD_VAL_SIZE, INNER_VAL_SIZE, N_FOLDS, VAL_RATIO
from panelyard.operators.series import BLOCK_STEPS


def step_positions(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ts_index, pos, n): position of each distinct step, and how many there are.

    Steps are numbered inside fixed time blocks and block counts are summed up, so no
    task orders more than one block or the list of blocks.
    """
    by = list(by)
    steps = df.select(*by, "ts_index").distinct()
    blocked = steps.withColumn("_block", F.floor(F.col("ts_index") / BLOCK_STEPS))
    all_blocks = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = all_blocks.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy(*by, "_block")
        .agg(F.count(F.lit(1)).alias("_k"))
        .select(
            *by,
            "_block",
            F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_offset"),
            F.sum("_k").over(all_blocks).alias("n"),
        )
    )
    inside = Window.partitionBy(*by, "_block").orderBy("ts_index")
    numbered = blocked.withColumn("_in_block", F.row_number().over(inside))
    return numbered.join(blocks, [*by, "_block"]).select(
        *by, "ts_index", (F.col("_offset") + F.col("_in_block") - 1).alias("pos"), "n"
    )


def time_split(df: DataFrame, val_ratio: float = VAL_RATIO) -> int:
    """First validation step: the last `val_ratio` of the distinct steps validate."""
    if not 0.0 < val_ratio < 1.0:
        raise ValueError("val_ratio must be between 0 and 1")
    cut = F.least(F.greatest(F.floor((1.0 - val_ratio) * F.col("n")), F.lit(1)), F.col("n") - 1)
    row = (
        step_positions(df)
        .groupBy()
        .agg(F.max("n").alias("n"), F.max(F.when(F.col("pos") == cut, F.col("ts_index"))).alias("start"))
        .first()
    )
    if row["n"] is None or row["n"] < 3:
        raise ValueError("a split needs at least 3 distinct ts_index values")
    return int(row["start"])


def split_at(df: DataFrame, val_start: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("ts_index") < val_start), df.where(F.col("ts_index") >= val_start)


def walk_forward_folds(
    df: DataFrame,
    n_folds: int = N_FOLDS,
    val_size: int = FOLD_VAL_SIZE,
    min_train_size: int = FOLD_MIN_TRAIN,
) -> DataFrame:
    """(horizon, fold, train_end_ts, val_start_ts, val_end_ts) for all horizons at once."""
    for name, value in (("n_folds", n_folds), ("val_size", val_size), ("min_train_size", min_train_size)):
        if value < 1:
            raise ValueError(f"{name} must be >= 1")
    total = n_folds * val_size
    positions = step_positions(df, ["horizon"])
    start = F.greatest(F.col("n") - total, F.lit(min_train_size))
    placed = positions.withColumn("_start", start).withColumn(
        "fold", F.floor((F.col("pos") - F.col("_start")) / val_size).cast("int") + 1
    )
    too_short = (F.col("n") <= min_train_size + val_size) | (F.lit(total) >= F.col("n"))
    message = F.lit("not enough distinct ts_index values for the requested folds")
    checked = placed.where(F.when(too_short, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    in_fold = (F.col("fold") >= 1) & (F.col("fold") <= n_folds)
    # The step before a fold's first one ends its training span.
    before_fold = F.floor((F.col("pos") + 1 - F.col("_start")) / val_size).cast("int") + 1
    opens = (F.col("pos") + 1 - F.col("_start")) % val_size == 0
    bounds = checked.where(in_fold).groupBy("horizon", "fold").agg(
        F.min("ts_index").alias("val_start_ts"), F.max("ts_index").alias("val_end_ts")
    )
    ends = checked.where(opens & (before_fold >= 1) & (before_fold <= n_folds)).select(
        "horizon", before_fold.alias("fold"), F.col("ts_index").alias("train_end_ts")
    )
    return bounds.join(ends, ["horizon", "fold"]).select(
        "horizon", "fold", "train_end_ts", "val_start_ts", "val_end_ts"
    )


def fold_membership(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once per fold it takes part in, with `fold` and `role` (fit / val).

    An equi join on `horizon` with the time bounds as a residual. The fold table has
    n_folds rows per horizon, a number fixed by the caller.
    """
    spans = F.broadcast(folds.select("horizon", "fold", "val_start_ts", "val_end_ts"))
    joined = df.join(spans, "horizon").where(F.col("ts_index") <= F.col("val_end_ts"))
    role = F.when(F.col("ts_index") < F.col("val_start_ts"), "fit").otherwise("val")
    return joined.select(*df.columns, "fold", role.alias("role"))


def with_segment(df: DataFrame, level1_threshold: int, meta_threshold: int) -> DataFrame:
    """Add `segment`: base, meta or eval."""
    segment = (
        F.when(F.col("ts_index") <= level1_threshold, "base")
        .when(F.col("ts_index") <= meta_threshold, "meta")
        .otherwise("eval")
    )
    return df.withColumn("segment", segment)


def check_segments(df: DataFrame) -> None:
    """Raise when a horizon lacks one of the three segments."""
    counts = {(r["horizon"], r["segment"]): r["count"] for r in df.groupBy("horizon", "segment").count().collect()}
    for horizon in {h for h, _ in counts}:
        sizes = {s: counts.get((horizon, s), 0) for s in ("base", "meta", "eval")}
        if min(sizes.values()) == 0:
            raise ValueError(f"horizon {horizon}: base, meta and eval must be non-empty, got {sizes}")
    if not counts:
        raise ValueError("base, meta and eval must be non-empty, got no rows")


def inner_cutoff(base: DataFrame, inner_val_size: int = INNER_VAL_SIZE) -> DataFrame:
    """(horizon, cutoff_ts): first of the last `inner_val_size` steps of the base segment."""
    positions = step_positions(base, ["horizon"])
    message = F.lit(f"inner_val_size={inner_val_size} is too large for the base segment")
    enough = F.when(F.col("n") <= inner_val_size, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return positions.where(enough & (F.col("pos") == F.col("n") - inner_val_size)).select(
        "horizon", F.col("ts_index").alias("cutoff_ts")
    )


def with_inner_split(base: DataFrame, inner_val_size: int = INNER_VAL_SIZE) -> DataFrame:
    """Add `is_val`. The cutoff table has one row per horizon."""
    cutoffs = F.broadcast(inner_cutoff(base, inner_val_size))
    joined = base.join(cutoffs, "horizon")
    return joined.select(*base.columns, (F.col("ts_index") >= F.col("cutoff_ts")).alias("is_val"))
