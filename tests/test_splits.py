import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelyard.operators import sampling, splits

RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def steps(spark, values, horizons=(1,)):
    return spark.createDataFrame(
        [(f"{h}_{i}", h, int(t)) for h in horizons for i, t in enumerate(values)], "id string, horizon int, ts_index int"
    )


@given(st.sets(st.integers(-5000, 20_000), min_size=3, max_size=60), st.floats(0.01, 0.99))
@RELAXED
def test_time_split(spark, values, ratio):
    ordered = sorted(values)
    at = max(1, min(int(np.floor((1.0 - ratio) * len(ordered))), len(ordered) - 1))
    df = steps(spark, [*ordered, *ordered[:2]])
    assert splits.time_split(df, ratio) == ordered[at]


def test_time_split_errors(spark):
    with pytest.raises(ValueError):
        splits.time_split(steps(spark, [1, 2]), 0.15)
    for ratio in (0.0, 1.0):
        with pytest.raises(ValueError):
            splits.time_split(steps(spark, [1, 2, 3]), ratio)


@given(
    st.lists(st.integers(1, 9), min_size=20, max_size=60), st.integers(1, 3), st.integers(1, 6), st.integers(1, 10)
)
@RELAXED
def test_folds(spark, gaps, n_folds, val_size, min_train):
    ordered = np.cumsum(gaps).tolist()
    n = len(ordered)
    df = steps(spark, ordered, (1, 25))
    if n <= min_train + val_size or n_folds * val_size >= n:
        with pytest.raises(Exception, match="not enough"):
            splits.walk_forward_folds(df, n_folds, val_size, min_train).collect()
        return
    start = max(n - n_folds * val_size, min_train)
    want = []
    for i in range(n_folds):
        a = start + i * val_size
        if a < n:
            want.append((i + 1, ordered[a - 1], ordered[a], ordered[min(a + val_size - 1, n - 1)]))
    got = splits.walk_forward_folds(df, n_folds, val_size, min_train).orderBy("horizon", "fold").collect()
    for h in (1, 25):
        assert [tuple(r)[1:] for r in got if r["horizon"] == h] == want


def test_fold_arguments(spark):
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            splits.walk_forward_folds(steps(spark, range(9)), *bad)


def test_fold_membership_never_leaks(spark, train):
    folds = splits.walk_forward_folds(train, min_train_size=900)
    members = splits.fold_membership(train, folds)
    edges = members.groupBy("horizon", "fold").agg(
        F.max(F.when(F.col("role") == "fit", F.col("ts_index"))).alias("last_fit"),
        F.min(F.when(F.col("role") == "val", F.col("ts_index"))).alias("first_val"),
    )
    joined = edges.join(folds, ["horizon", "fold"]).collect()
    assert len(joined) == 12
    assert all(r["last_fit"] == r["train_end_ts"] < r["val_start_ts"] == r["first_val"] for r in joined)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_segments_and_inner_split(spark):
    df = splits.with_segment(steps(spark, range(30)), 19, 24)
    counts = {r["segment"]: r["count"] for r in df.groupBy("segment").count().collect()}
    assert counts == {"base": 20, "meta": 5, "eval": 5}
    splits.check_segments(df)
    with pytest.raises(ValueError):
        splits.check_segments(df.where("segment != 'meta'"))
    inner = splits.with_inner_split(steps(spark, range(30)), 7).where("is_val").agg(F.min("ts_index")).first()[0]
    assert inner == 23
    with pytest.raises(Exception, match="too large"):
        splits.with_inner_split(steps(spark, range(5)), 5).collect()


def test_stratified_sample(spark):
    rows = [(f"{h}_{i}", h, i) for h, n in ((1, 500), (3, 10), (10, 500), (25, 500)) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, horizon int, ts_index int").repartition(5)
    drawn = sampling.stratified_sample(df, 203)
    counts = {r["horizon"]: r["count"] for r in drawn.groupBy("horizon").count().collect()}
    # 51 + 51 + 51 + 50, horizon 3 has ten rows, the missing 41 come from anywhere else.
    assert sum(counts.values()) == 203 and counts[3] == 10
    assert counts[1] >= 51 and counts[10] >= 51 and counts[25] >= 50
    assert drawn.select("id").distinct().count() == 203
    again = sampling.stratified_sample(df.repartition(3), 203)
    assert drawn.exceptAll(again).count() == 0
    assert drawn.exceptAll(sampling.stratified_sample(df, 203, seed=7)).count() > 0
    assert sampling.stratified_sample(df, 5_000).count() == len(rows)
    assert sampling.sample_rows(df, 77).count() == 77
    with pytest.raises(ValueError):
        sampling.stratified_sample(df, 0)
