"""Panel checks as a report: (check, table, ok, n_bad, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.contract import HORIZONS, KEY_COLUMNS, TEST_FORBIDDEN, TEST_REQUIRED, TRAIN_REQUIRED

REPORT = "check string, table string, ok boolean, n_bad long, detail string"


def _columns_report(train: DataFrame, test: DataFrame) -> list[tuple]:
    missing = {
        "train": sorted(set(TRAIN_REQUIRED) - set(train.columns)),
        "test": sorted(set(TEST_REQUIRED) - set(test.columns)),
    }
    rows = [
        ("required_columns", table, not names, len(names), ",".join(names)) for table, names in missing.items()
    ]
    forbidden = sorted(set(TEST_FORBIDDEN) & set(test.columns))
    rows.append(("forbidden_columns", "test", not forbidden, len(forbidden), ",".join(forbidden)))
    return rows


def _line(check: str, table: str, n_bad, detail):
    return (
        F.lit(check).alias("check"),
        F.lit(table).alias("table"),
        (n_bad == 0).alias("ok"),
        n_bad.cast("long").alias("n_bad"),
        detail.cast("string").alias("detail"),
    )


def duplicates(df: DataFrame, columns) -> DataFrame:
    """Values of `columns` that occur more than once, with their counts."""
    return df.groupBy(*columns).count().where(F.col("count") > 1)


def _unique(df: DataFrame, table: str, check: str, columns) -> DataFrame:
    found = duplicates(df, columns).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*_line(check, table, F.col("n"), F.concat(F.col("n").cast("string"), F.lit(" repeated values"))))


def _horizons(df: DataFrame, table: str) -> DataFrame:
    # Distinct values first: one row per horizon is left to look at.
    odd = df.groupBy("horizon").count().where(~F.coalesce(F.col("horizon").isin(*HORIZONS), F.lit(False)))
    found = odd.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n"),
        F.coalesce(F.max(F.col("horizon").cast("string")), F.lit("")).alias("worst"),
    )
    return found.select(*_line("horizon_domain", table, F.col("n"), F.col("worst")))


def _boundary(train: DataFrame, test: DataFrame) -> DataFrame:
    ends = (
        train.agg(F.max("ts_index").alias("t"))
        .select("t", F.lit("train").alias("side"))
        .unionByName(test.agg(F.min("ts_index").alias("t")).select("t", F.lit("test").alias("side")))
        .agg(
            F.max(F.when(F.col("side") == "train", F.col("t"))).alias("train_max"),
            F.max(F.when(F.col("side") == "test", F.col("t"))).alias("test_min"),
        )
    )
    bad = F.when(F.col("train_max") < F.col("test_min"), 0).otherwise(1)
    detail = F.concat_ws(" -> ", F.col("train_max").cast("string"), F.col("test_min").cast("string"))
    return ends.select(*_line("temporal_boundary", "both", bad, detail))


def validate_panel(train: DataFrame, test: DataFrame, raise_on_error: bool = False) -> DataFrame:
    """Run every check. Missing columns are reported alone: the others need them."""
    spark = train.sparkSession
    column_rows = _columns_report(train, test)
    report = spark.createDataFrame(column_rows, REPORT)
    if all(ok for check, _, ok, _, _ in column_rows if check == "required_columns"):
        parts = [report]
        for name, df in (("train", train), ("test", test)):
            parts.append(_unique(df, name, "unique_id", ["id"]))
            parts.append(_unique(df, name, "unique_key", KEY_COLUMNS))
            parts.append(_horizons(df, name))
        parts.append(_boundary(train, test))
        report = reduce(DataFrame.unionByName, parts)
    if raise_on_error:
        failed = report.where("NOT ok").collect()
        if failed:
            raise ValueError("; ".join(f"{r['check']} ({r['table']}): {r['detail']}" for r in failed))
    return report
