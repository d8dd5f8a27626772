"""Ordered work inside a series: chunking of long series, fills, exponential means."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.contract import SERIES
from panelyard.operators.group_sizes import GroupSizes, split_hot

# Steps per time block when rows of a long series are numbered. A series has at most
# one row per step, so a block holds at most this many rows, and a 32-bit step number
# gives at most 2**20 blocks per series.
BLOCK_STEPS = 4096
# Rows per chunk of a long series.
CHUNK_ROWS = 500_000
# exp() of a within-block log decay stays finite up to this range.
LOG_RANGE = 600.0
# exp(-45) is far below the rounding of a double.
NEGLIGIBLE_LOG = 45.0


def series_window(keys: Sequence[str] = SERIES):
    return Window.partitionBy(*keys).orderBy("ts_index")


def with_series_position(df: DataFrame, name: str = "_pos") -> DataFrame:
    """Zero-based row position in each series, without ever sorting a whole series at once.

    Rows are numbered inside fixed time blocks, block counts are summed up per series,
    and the two are added.
    """
    keyed = df.withColumn("_block", F.floor(F.col("ts_index") / BLOCK_STEPS))
    block_keys = [*SERIES, "_block"]
    before = Window.partitionBy(*SERIES).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*block_keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(k).alias(f"_o_{k}") for k in block_keys],
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    numbered = keyed.withColumn(
        "_in_block", F.row_number().over(Window.partitionBy(*block_keys).orderBy("ts_index"))
    )
    condition = F.lit(True)
    for k in block_keys:
        condition = condition & numbered[k].eqNullSafe(offsets[f"_o_{k}"])
    joined = numbered.join(offsets, condition)
    return joined.select(*df.columns, (F.col("_offset") + F.col("_in_block") - 1).alias(name))


def chunk_series(df: DataFrame, look_back: int, look_ahead: int, chunk_rows: int | None = None) -> DataFrame:
    """Cut series into chunks of `chunk_rows`; rows near a boundary are also copied next door.

    Adds `_chunk` and `_halo`. A window over SERIES + _chunk then sees everything a
    frame of `look_back` / `look_ahead` rows needs; copies are dropped afterwards.
    """
    chunk_rows = max(chunk_rows or CHUNK_ROWS, look_back, look_ahead)
    placed = with_series_position(df)
    chunk = F.floor(F.col("_pos") / chunk_rows)
    offset = F.col("_pos") % chunk_rows
    homes = [F.struct(chunk.alias("chunk"), F.lit(False).alias("halo"))]
    if look_back:
        homes.append(
            F.when(
                offset >= chunk_rows - look_back,
                F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("halo")),
            )
        )
    if look_ahead:
        homes.append(
            F.when(offset < look_ahead, F.struct((chunk - 1).alias("chunk"), F.lit(True).alias("halo")))
        )
    spread = placed.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
    return spread.select(*df.columns, F.col("_home.chunk").alias("_chunk"), F.col("_home.halo").alias("_halo"))


def over_series(
    df: DataFrame,
    build: Callable[[DataFrame, list[str], int], DataFrame],
    sizes: GroupSizes,
    look_back: int,
    look_ahead: int = 0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Apply `build(rows, partition_keys, rows_bound)` to every series.

    Ordinary series go to `build` as they are. Hot series are chunked first, so no task
    holds more than a chunk and its halo.
    """
    if sizes.hot_series is None:
        return build(df, list(SERIES), sizes.max_series_rows)
    ordinary, hot = split_hot(df, sizes.hot_series, SERIES)
    chunked = chunk_series(hot, look_back, look_ahead, chunk_rows)
    bound = max(chunk_rows or CHUNK_ROWS, look_back, look_ahead) + look_back + look_ahead
    built = build(chunked, [*SERIES, "_chunk"], bound).where(~F.col("_halo")).drop("_chunk", "_halo")
    return build(ordinary, list(SERIES), sizes.max_series_rows).unionByName(built)


def fill_series(
    df: DataFrame,
    columns: Sequence[str],
    sizes: GroupSizes,
    forward: bool = True,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Replace nulls by the last (or next) non-null value of the series."""

    def ordered(keys, order: str):
        # A running frame in either direction; one that ends at the last row is computed anew for
        # every row.
        return Window.partitionBy(*keys).orderBy(F.asc(order) if forward else F.desc(order))

    def pick(column: str, window) -> Column:
        return F.last(column, ignorenulls=True).over(window)

    def local(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = ordered(keys, "ts_index").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select(*[pick(c, w).alias(c) if c in columns else F.col(c) for c in rows.columns])

    if sizes.hot_series is None:
        return local(df, list(SERIES))

    ordinary, hot = split_hot(df, sizes.hot_series, SERIES)
    chunk_keys = [*SERIES, "_chunk"]
    chunked = chunk_series(hot, 0, 0, chunk_rows).drop("_halo")
    edge = F.max_by if forward else F.min_by
    edges = chunked.groupBy(*chunk_keys).agg(
        *[edge(c, F.when(F.col(c).isNotNull(), F.col("ts_index"))).alias(c) for c in columns]
    )
    w = ordered(SERIES, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *[F.col(k).alias(f"_e_{k}") for k in chunk_keys], *[pick(c, w).alias(f"_e_{c}") for c in columns]
    )
    filled = local(chunked, chunk_keys)
    condition = F.lit(True)
    for k in chunk_keys:
        condition = condition & filled[k].eqNullSafe(carried[f"_e_{k}"])
    joined = filled.join(carried, condition).select(
        *[F.coalesce(c, f"_e_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )
    return local(ordinary, list(SERIES)).unionByName(joined)


def _decay(span: int) -> tuple[float, float]:
    alpha = 2.0 / (span + 1.0)
    return alpha, 1.0 - alpha


def _slowest_decay_per_row(span: int) -> float:
    """Smallest log decay per row over all gap lengths between observations."""
    alpha, keep = _decay(span)
    return min(-(g * math.log(keep) - math.log(keep**g + alpha)) / g for g in range(1, 40 * span))


def ewm_block_rows(spans: Sequence[int]) -> int:
    """Rows over which the fastest-decaying span still fits in a double's range."""
    return int(min(LOG_RANGE / -math.log(_decay(s)[1]) for s in spans))


def ewm_carry_blocks(spans: Sequence[int]) -> int:
    """Earlier blocks that can still be seen in a value."""
    slowest = min(_slowest_decay_per_row(s) for s in spans)
    return max(2, math.ceil(NEGLIGIBLE_LOG / (slowest * ewm_block_rows(spans))) + 1)


def ewm_look_back(spans: Sequence[int]) -> int:
    return (ewm_carry_blocks(spans) + 1) * ewm_block_rows(spans)


def add_ewm(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    spans: Sequence[int],
    rows_bound: int,
    null_policy: str,
) -> DataFrame:
    """Add `{column}_ewm{span}`: the exponentially weighted mean, seeded with the first value.

    With g rows since the last observation, y = (d^g y_prev + alpha x) / (d^g + alpha),
    a linear recurrence y = a y_prev + u. Its solution is a running sum of u / A scaled
    by the running product A, kept in logs. A runs over at most `ewm_block_rows` rows, so
    nothing overflows; longer series pass the value at each block's end to the next block.

    null_policy "carry" repeats the last value on null rows, "null" leaves them null.
    """
    if null_policy not in ("carry", "null"):
        raise ValueError("null_policy must be 'carry' or 'null'")
    block_rows = ewm_block_rows(spans)
    one_block = rows_bound <= block_rows
    pairs = [(c, s) for c in columns for s in spans]
    base = list(df.columns)

    by_time = Window.partitionBy(*keys).orderBy("ts_index")
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.select(*base, F.row_number().over(by_time).alias("_rn"))
    seen = numbered.select(
        *base,
        "_rn",
        *[
            F.last(F.when(F.col(c).isNotNull(), F.col("_rn")), ignorenulls=True).over(earlier).alias(f"_seen_{c}")
            for c in columns
        ],
        (F.lit(0) if one_block else F.floor((F.col("_rn") - 1) / block_rows)).alias("_blk"),
    )
    carried_names = [*base, "_rn", "_blk", *[f"_seen_{c}" for c in columns]]

    if one_block:
        in_block = series_order = by_time
    else:
        in_block = Window.partitionBy(*keys, "_blk").orderBy("ts_index")
        series_order = Window.partitionBy(*keys).orderBy("_blk", "ts_index")

    def parts(c: str, s: int):
        """(observed, first of its block, log a, u) for one column and span."""
        alpha, keep = _decay(s)
        gap = F.col("_rn") - F.col(f"_seen_{c}")
        kept = F.exp(gap * math.log(keep))
        log_a = gap * math.log(keep) - F.log(kept + alpha)
        observed = F.col(c).isNotNull()
        opening = F.col(f"_seen_{c}").isNull() | (F.col(f"_seen_{c}") <= F.col("_blk") * block_rows)
        u = F.when(F.col(f"_seen_{c}").isNull(), F.col(c)).otherwise(alpha * F.col(c) / (kept + alpha))
        return observed, opening, log_a, u

    zero = F.lit(0.0)
    logs = []
    for c, s in pairs:
        observed, opening, log_a, _ = parts(c, s)
        logs.append(
            F.sum(F.when(observed & ~opening, log_a).otherwise(zero)).over(in_block).alias(f"_rel_{c}_{s}")
        )
        if not one_block:
            entering = F.when(observed & opening, F.coalesce(log_a, zero)).otherwise(zero)
            logs.append(F.sum(entering).over(in_block).alias(f"_enter_{c}_{s}"))
    with_logs = seen.select(*carried_names, *logs)

    state = []
    for c, s in pairs:
        observed, _, _, u = parts(c, s)
        rel = F.col(f"_rel_{c}_{s}")
        running = F.sum(F.when(observed, u * F.exp(-rel)).otherwise(zero)).over(in_block)
        state.append((F.exp(rel) * running).alias(f"_loc_{c}_{s}"))
        if not one_block:
            state.append((rel + F.col(f"_enter_{c}_{s}")).alias(f"_e_{c}_{s}"))
    current = with_logs.select(*carried_names, *state)
    value = {(c, s): F.col(f"_loc_{c}_{s}") for c, s in pairs}

    if not one_block:
        earlier_rows = series_order.rowsBetween(Window.unboundedPreceding, -1)
        state_names = [f"_{kind}_{c}_{s}" for c, s in pairs for kind in ("loc", "e")]
        for _ in range(ewm_carry_blocks(spans)):
            last_seen = [
                F.last(F.when(F.col(c).isNotNull(), value[c, s]), ignorenulls=True)
                .over(earlier_rows)
                .alias(f"_last_{c}_{s}")
                for c, s in pairs
            ]
            current = current.select(*carried_names, *state_names, *last_seen)
            entry = [F.first(f"_last_{c}_{s}").over(in_block).alias(f"_in_{c}_{s}") for c, s in pairs]
            current = current.select(*carried_names, *state_names, *entry)
            value = {
                (c, s): F.col(f"_loc_{c}_{s}")
                + F.exp(F.col(f"_e_{c}_{s}")) * F.coalesce(F.col(f"_in_{c}_{s}"), zero)
                for c, s in pairs
            }

    def shown(c: str) -> Column:
        observed = F.col(c).isNotNull()
        return observed if null_policy == "null" else observed | F.col(f"_seen_{c}").isNotNull()

    return current.select(*base, *[F.when(shown(c), value[c, s]).alias(f"{c}_ewm{s}") for c, s in pairs])
