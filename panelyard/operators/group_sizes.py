"""How large the panel's natural groups are, and which of them are hot.

Window functions keep one group in one task. That is right for ordinary series
and cross-sections, and wrong for a group that holds a large share of the table.
Feature operators therefore take a `GroupSizes`: groups at or under the limit use
plain windows, hot ones go through an equivalent plan that splits them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.contract import SECTION, SERIES
from panelyard.sources.panel_io import stored

# Rows a single window group may hold before it is split.
GROUP_ROW_LIMIT = 1_000_000


@dataclass(frozen=True)
class GroupSizes:
    """Upper bounds of the group sizes; `hot_*` is None when no group exceeds the limit. `rows` bounds
    the whole table, 0 where that is not known."""

    max_series_rows: int
    max_section_rows: int
    hot_series: DataFrame | None = None
    hot_sections: DataFrame | None = None
    rows: int = 0


def largest_group(df: DataFrame, keys) -> int:
    """Rows in the largest group: counts are combined map-side, one number comes back."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def largest_and_all(df: DataFrame, keys) -> tuple[int, int]:
    """(rows in the largest group, rows of all groups), in the same way."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n"), F.sum("count").alias("rows")).first()
    return int(row["n"] or 0), int(row["rows"] or 0)


def hot_keys(df: DataFrame, keys, limit: int) -> DataFrame:
    """Keys of the groups above `limit`, counted once and stored."""
    return stored(df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys), "hot-keys")


def measure(df: DataFrame, limit: int = GROUP_ROW_LIMIT) -> GroupSizes:
    """Measure both groupings; reads only the key columns."""
    series_rows = largest_group(df, SERIES)
    section_rows, rows = largest_and_all(df, SECTION)
    return GroupSizes(
        max_series_rows=series_rows,
        max_section_rows=section_rows,
        hot_series=hot_keys(df, SERIES, limit) if series_rows > limit else None,
        hot_sections=hot_keys(df, SECTION, limit) if section_rows > limit else None,
        rows=rows,
    )


def split_hot(df: DataFrame, hot: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """(ordinary rows, rows of hot groups). The keys are a stored table of known size: Spark
    broadcasts them while they are under its threshold."""
    marked = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(marked[f"_hot_{k}"])
    return df.join(marked, condition, "left_anti"), df.join(marked, condition, "left_semi")
