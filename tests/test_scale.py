"""Plans and run times that must hold on larger tables."""

import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from panelyard.contract import SERIES
from panelyard.operators import cross_section, encoding, scoring, series
from panelyard.operators.group_sizes import GroupSizes


def test_backward_fill_is_linear(spark):
    df = spark.range(200_000).select(
        *[F.lit("a").alias(k) if k != "horizon" else F.lit(1).alias(k) for k in SERIES],
        F.col("id").alias("ts_index"),
        F.when(F.col("id") == 199_999, 5.0).alias("v"),
    )
    start = time.perf_counter()
    filled = series.fill_series(df, ["v"], GroupSizes(200_000, 1), forward=False)
    assert filled.where("v = 5.0").count() == 200_000
    assert time.perf_counter() - start < 60


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_hierarchy_block_has_one_exchange(spark, train):
    valued = cross_section.section_values(train, ["feature_al"], GroupSizes(1, 1), levels=True)
    assert exchanges(valued) == 1


def test_selection_does_not_shuffle_on_horizon(spark, train):
    chosen = spark.createDataFrame([(h, "lgb") for h in (1, 3, 10, 25)], "horizon int, candidate string")
    rows = train.select("id", "horizon", F.col("feature_al").alias("pred_lgb"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert exchanges(scoring.apply_selection(rows, chosen, names=("lgb",))) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_small_encodings_move_no_rows(spark, train):
    """Whatever the stored encoding's size, the joins with few rows (horizons, categories) do not deal out the rows."""
    fitted = encoding.fit_encoding(train)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        encoded = encoding.apply_encoding(train, fitted)
        assert exchanges(encoded) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_encodings_of_unseen_and_null_keys(spark):
    rows = [(1, "K", "S1", 2.0), (1, "K", "S2", 4.0), (3, None, "S1", 8.0), (None, "K", "S1", 5.0)]
    schema = "horizon int, sub_category string, sub_code string, y_target double"
    df = spark.createDataFrame([*rows, (3, "Z", "S9", None)], schema)
    got = encoding.apply_encoding(df, encoding.fit_encoding(spark.createDataFrame(rows, schema)))
    seen = [(r["horizon"], r["sub_code"], r["sub_category_enc"], r["sub_code_enc"]) for r in got.collect()]
    assert sorted(seen, key=str) == sorted(
        [(1, "S1", 3.0, 2.0), (1, "S2", 3.0, 4.0), (3, "S1", 8.0, 8.0), (None, "S1", None, None), (3, "S9", 8.0, 8.0)], key=str
    )


def test_stored_tables_go_with_the_driver(tmp_path):
    root = Path(__file__).resolve().parents[1]
    script = (
        "from pyspark.sql import SparkSession\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', '{tmp_path}')"
        ".config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from panelyard.sources.panel_io import run_folder, stored\n"
        "assert stored(s.range(3), 'x').count() == 3\n"
        "print(run_folder(s))\n"
        "s.stop()\n"
    )
    ran = subprocess.run(
        [sys.executable, "-c", script], cwd=root, capture_output=True, text=True, timeout=180, check=True
    )
    folder = Path(ran.stdout.split()[-1])
    for _ in range(60):  # the JVM ends a little after the driver's Python
        if not folder.exists():
            break
        time.sleep(0.5)
    assert folder.parent == tmp_path and not folder.exists()
