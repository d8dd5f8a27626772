import json

import pytest
from pyspark.sql import functions as F

from panelyard.operators import impute, profile, validate
from panelyard.plans import baseline
from panelyard.sources import panel_io
from tests.conftest import SMALL


def failing(report):
    return {(r["check"], r["table"]) for r in report.where("NOT ok").collect()}


def test_clean_panel_passes(train, test_rows):
    report = validate.validate_panel(train, test_rows, raise_on_error=True)
    assert report.count() == 10 and failing(report) == set()


def test_each_defect_is_reported(train, test_rows):
    one = train.limit(1)
    assert failing(validate.validate_panel(train.unionByName(one), test_rows)) == {
        ("unique_id", "train"), ("unique_key", "train"),
    }
    assert ("horizon_domain", "test") in failing(
        validate.validate_panel(train, test_rows.withColumn("horizon", F.lit(7)))
    )
    late = test_rows.withColumn("ts_index", F.col("ts_index") - 500)
    assert ("temporal_boundary", "both") in failing(validate.validate_panel(train, late))
    assert failing(validate.validate_panel(train, test_rows.withColumn("y_target", F.lit(0.0)))) == {
        ("forbidden_columns", "test")
    }
    assert failing(validate.validate_panel(train.drop("weight"), test_rows)) == {("required_columns", "train")}
    with pytest.raises(ValueError, match="unique_id"):
        validate.validate_panel(train.unionByName(one), test_rows, raise_on_error=True)


def test_horizon_scan_reaches_parquet(spark, train, test_rows, tmp_path):
    train.withColumn("feature_al", F.when(F.col("ts_index") % 2 == 0, float("nan")).otherwise(F.col("feature_al"))).withColumn(
        "extra", F.lit("x")
    ).write.parquet(f"{tmp_path}/train")
    test_rows.write.parquet(f"{tmp_path}/test")
    a, b = panel_io.read_horizon(spark, f"{tmp_path}/train", f"{tmp_path}/test", 10)
    assert a.select("horizon").distinct().collect()[0][0] == 10
    assert a.where(F.isnan("feature_al")).count() == 0 and a.where("feature_al IS NULL").count() > 0
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(horizon,10)" in plan and "extra" not in plan
    assert "y_target" not in b.columns
    capped, head = panel_io.cap_tail(a, 25), panel_io.cap_head(b, 13)
    assert capped.count() == 25 and head.count() == 13
    last = a.toPandas().sort_values(["code", "sub_code", "sub_category", "horizon", "ts_index"]).tail(25)
    assert set(capped.toPandas()["id"]) == set(last["id"])


def test_prediction_file_round_trip(spark, test_rows, tmp_path):
    good = test_rows.select("id", F.lit(1.5).alias("prediction"))
    panel_io.write_predictions(test_rows, good, f"{tmp_path}/p")
    row = panel_io.check_prediction_file(spark, f"{tmp_path}/p").first()
    assert tuple(row) == (test_rows.count(), 0, 0)
    for bad in (good.limit(10), good.unionByName(good.limit(1)), good.withColumn("id", F.concat("id", F.lit("x")))):
        with pytest.raises(ValueError):
            panel_io.write_predictions(test_rows, bad, f"{tmp_path}/q")


def test_summary_round_trip(spark, tmp_path):
    for objectives in ("regression,huber", json.dumps(["regression", "huber"])):
        payload = {
            "objectives": objectives, "seeds": [42, 143], "final_metric": 0.5,
            "score_by_horizon": {"1": 0.1}, "best_iterations": {"1": {"regression_s42": 7}},
            "feature_config_by_horizon": {"1": json.dumps({"lags": [1]})}, "params": json.dumps({"a": 1}),
        }
        path = f"{tmp_path}/{len(objectives)}"
        panel_io.write_summary(spark, payload, path)
        got = panel_io.read_summary(spark, path)
        assert got["objectives"] == ["regression", "huber"] and got["seeds"] == [42, 143]
        assert got["best_iterations"] == {1: {"regression_s42": 7}} and got["score_by_horizon"] == {1: 0.1}
        assert got["feature_config_by_horizon"] == {1: {"lags": [1]}}


def test_parquet_profile(spark):
    row = panel_io.parquet_profile(spark, {"lineitem": f"{SMALL}/lineitem.parquet"}).first()
    assert row["rows"] == spark.read.parquet(f"{SMALL}/lineitem.parquet").count() and row["columns"] == 11
    import os

    assert row["mb"] == pytest.approx(os.path.getsize(f"{SMALL}/lineitem.parquet") / 1024**2)


def test_baseline_summary(train):
    s = baseline.baseline_summary(train)
    assert s["rows_fit"] + s["rows_val"] == train.count() and 0 <= s["final_metric"] <= 1


def test_ranking_ties_in_name_order(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 2.0, 5.0)], "feature_b double, feature_a double, feature_c double")
    assert [r["feature"] for r in profile.feature_ranking(df, 3).collect()] == ["feature_a", "feature_b", "feature_c"]


def test_matrix_fit_and_transform(spark):
    rows = [("K1", "S1", 1.0, None), ("K1", "S1", 3.0, None), ("K1", "S2", None, None), ("K2", "S3", None, None)]
    schema = "sub_category string, sub_code string, feature_a double, feature_b double"
    df = spark.createDataFrame(rows, schema)
    fitted, stats = impute.prepare_research_matrix(df, "fit")
    got = [(r["sub_category"], r["feature_a"], r["feature_b"]) for r in fitted.orderBy("sub_code", "feature_a").collect()]
    # Category median, then overall median, then zero.
    assert got == [("K1", 1.0, 0.0), ("K1", 3.0, 0.0), ("K1", 2.0, 0.0), ("K2", 2.0, 0.0)]
    new = spark.createDataFrame([("K9", None)], "sub_category string, feature_a double")
    moved, _ = impute.prepare_research_matrix(new, "transform", stats)
    row = moved.first()
    assert moved.columns == stats.order and row["feature_a"] == 2.0 and row["feature_b"] == 0.0 and row["sub_code"] is None
    with pytest.raises(ValueError):
        impute.prepare_research_matrix(df, "transform")
    with pytest.raises(ValueError):
        impute.prepare_research_matrix(df, "other")


def test_stats_save_and_load(spark, train, tmp_path):
    numeric, categorical = impute.baseline_columns(train, True)
    stats = impute.fit_stats(train, numeric, categorical)
    stats.save(f"{tmp_path}/s")
    back = impute.FillStats.load(spark, f"{tmp_path}/s")
    assert back.numeric == stats.numeric and back.categorical == stats.categorical and back.group == ()
    assert impute.fill(train, back).exceptAll(impute.fill(train, stats)).count() == 0
