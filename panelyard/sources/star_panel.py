"""The working panel, derived from `lineitem` and `supplier`.

One series per (supplier, return flag), one step per ship day, four horizons.
A series holds at most one row per calendar day.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.contract import HORIZONS
from panelyard.operators.group_sizes import GROUP_ROW_LIMIT, GroupSizes, largest_and_all, largest_group, measure
from panelyard.sources.panel_io import run_folder

EPOCH_DAY = "1992-01-01"
TEST_START = 3420
LEVEL1_THRESHOLD = 3250
META_THRESHOLD = 3335
FOLD_MIN_TRAIN = 900


#: Line items per partition of the derivation, and so per bucket of the stored table.
BUCKET_ITEMS = 250_000
MOST_BUCKETS = 8192


def _dealing(spark: SparkSession, sf_dir: str) -> tuple[int, bool]:
    """(buckets, combine first). The buckets grow with the line items, so that what one task holds
    does not; one supplier with more line items than a group may have rows is combined first."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sizes = items.groupBy("l_suppkey").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    wanted = max(spark.sparkContext.defaultParallelism, math.ceil((sizes["n"] or 0) / BUCKET_ITEMS))
    return min(wanted, MOST_BUCKETS), (sizes["most"] or 0) > GROUP_ROW_LIMIT


def daily_sales(spark: SparkSession, sf_dir: str, buckets: int, combine_first: bool) -> DataFrame:
    """One row per supplier, return flag and ship day, with the five signals, dealt by `sub_code`.

    The line items are dealt out once, by supplier: the daily aggregate, the supplier's nation and
    all series windows find their rows there. With `combine_first` they are combined
    before they are dealt.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sub_code = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sub_code")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        sub_code, F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("code")
    )
    # A line item without a supplier finds no nation.
    narrow = items.where("l_suppkey IS NOT NULL").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sub_code"),
        F.concat(F.lit("K"), F.col("l_returnflag")).alias("sub_category"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit(EPOCH_DAY).cast("date")).alias("ts_index"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.when(F.col("l_linenumber") <= 2, F.col("l_extendedprice")).alias("early_price"),
    )
    if not combine_first:
        narrow = narrow.repartition(buckets, "sub_code")
    daily = narrow.groupBy("sub_code", "sub_category", "ts_index").agg(
        F.sum("l_quantity").alias("feature_al"),
        F.max("l_extendedprice").alias("feature_am"),
        F.min("l_discount").alias("feature_by"),
        F.max("early_price").alias("feature_cg"),
        F.count(F.lit(1)).cast("double").alias("feature_s"),
        (F.max("l_extendedprice") / 1000).alias("weight"),
    )
    if combine_first:
        daily = daily.repartition(buckets, "sub_code")
    return daily.join(suppliers, "sub_code").select(
        "code",
        "sub_code",
        "sub_category",
        "ts_index",
        "feature_al",
        "feature_am",
        "feature_by",
        "feature_cg",
        "feature_s",
        "weight",
    )


def daily_targets(spark: SparkSession, sf_dir: str, buckets: int, combine_first: bool) -> DataFrame:
    """`daily_sales` with one forward-average target per horizon, as columns `y_<horizon>`."""
    ahead = Window.partitionBy("code", "sub_code", "sub_category").orderBy("ts_index")
    targets = [
        F.coalesce(F.avg("feature_al").over(ahead.rowsBetween(1, h)) - F.col("feature_al"), F.lit(0.0)).alias(f"y_{h}")
        for h in HORIZONS
    ]
    return daily_sales(spark, sf_dir, buckets, combine_first).select("*", *targets)


def _per_horizon(daily: DataFrame) -> DataFrame:
    """A row of `daily_targets` as one panel row per horizon. Rows stay in their partitions, so
    series windows downstream find them already where they need them."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_{h}").alias("y_target")) for h in HORIZONS])
    exploded = daily.select("*", F.inline(rows))
    return exploded.select(
        F.concat_ws(
            "_",
            "code",
            "sub_code",
            "sub_category",
            F.col("horizon").cast("string"),
            F.col("ts_index").cast("string"),
        ).alias("id"),
        "code",
        "sub_code",
        "sub_category",
        "horizon",
        "ts_index",
        "weight",
        "y_target",
        "feature_al",
        "feature_am",
        "feature_by",
        "feature_cg",
        "feature_s",
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole panel: signals, weight and a forward-average target per horizon."""
    return _per_horizon(daily_targets(spark, sf_dir, *_dealing(spark, sf_dir)))


# What this application has already derived, by (application, folder).
_tables: dict[tuple[str, str], str] = {}
_sizes: dict[tuple[str, str], GroupSizes] = {}


def panel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel over a stored table of daily rows, bucketed by `sub_code` in the run's folder.

    Derived once per application; the input files are taken not to change meanwhile. The horizons
    are spread at reading: a daily row is written once, not once per horizon, and its write sorts
    and shuffles nothing anew. Windows over series need no exchange; filters on time and the column
    list reach the scan.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        buckets, combine_first = _dealing(spark, sf_dir)
        daily = daily_targets(spark, sf_dir, buckets, combine_first)
        name = f"panel_{uuid.uuid4().hex}"
        path = f"{run_folder(spark)}/{name}"
        daily.write.bucketBy(buckets, "sub_code").option("path", path).saveAsTable(name)
        _tables[key] = name
    panel_rows = _per_horizon(spark.table(_tables[key]))
    return panel_rows.select(*[c for c in panel_rows.columns if c != "horizon"], "horizon")


def train_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_table(spark, sf_dir).where(F.col("ts_index") < TEST_START)


def test_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_table(spark, sf_dir).where(F.col("ts_index") >= TEST_START).drop("y_target")


def group_sizes(spark: SparkSession, sf_dir: str) -> GroupSizes:
    """Sizes of the panel's series and cross-sections, bounded from the line items.

    The daily aggregate only merges rows, so line items per (supplier, flag) bound a
    series, and line items per day bound one (horizon, day). Where a bound is above the limit, the panel itself is measured.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _sizes:
        return _sizes[key]
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    series_rows = largest_group(items, ["l_suppkey", "l_returnflag"])
    section_rows, rows = largest_and_all(items, [F.col("l_shipdate").cast("date")])
    if max(series_rows, section_rows) > GROUP_ROW_LIMIT:
        _sizes[key] = measure(panel_table(spark, sf_dir))
    else:
        _sizes[key] = GroupSizes(series_rows, section_rows, rows=rows * len(HORIZONS))
    return _sizes[key]
