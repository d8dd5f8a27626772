"""Series windows: pandas as the reference, and the split plan of hot series against it."""

import numpy as np
import pandas as pd
import pytest

from panelyard.contract import SERIES
from panelyard.operators import context_features as ctx
from panelyard.operators import research_features as rf
from panelyard.operators import series
from panelyard.operators.group_sizes import measure

LONG = 15_000


def panel_frame(lengths, missing=0.3, seed=0):
    rng = np.random.default_rng(seed)
    parts = []
    for i, n in enumerate(lengths):
        x = rng.normal(size=n) * 10 + 5
        x[rng.random(n) < missing] = np.nan
        if n > 6000:
            x[3000:5500] = np.nan  # a null run longer than a block
            x[-4000:] = np.nan
        steps = np.sort(rng.choice(n * 3, size=n, replace=False))
        parts.append(
            pd.DataFrame(
                {
                    "id": [f"{i}_{t}" for t in steps],
                    "code": "C",
                    "sub_code": f"S{i}",
                    "sub_category": "K",
                    "horizon": 1,
                    "ts_index": steps.astype("int32"),
                    "feature_al": x,
                    "feature_s": rng.integers(0, 5, n).astype(float),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf.astype({"horizon": "int32"}))
    from panelyard.sources.panel_io import nan_to_null

    return nan_to_null(df)


def close(got, want):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert (np.isnan(got) == np.isnan(want)).all()
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def ordered(df):
    return df.toPandas().sort_values([*SERIES, "ts_index"]).reset_index(drop=True)


def sizes_with_limit(df, limit):
    return measure(df, limit)


@pytest.fixture(scope="module")
def frame():
    return panel_frame([LONG, 300, 40, 1]).sort_values([*SERIES, "ts_index"]).reset_index(drop=True)


@pytest.mark.parametrize("limit", [10**9, 1_000])
def test_context_against_pandas(spark, frame, limit, monkeypatch):
    monkeypatch.setattr(series, "CHUNK_ROWS", 100)
    df = to_spark(spark, frame)
    sizes = measure(df, limit)
    assert (sizes.hot_series is not None) == (limit == 1_000)
    got = ordered(ctx.series_context(df, ["feature_al", "feature_s"], sizes))
    assert list(got["id"]) == list(frame["id"])
    for c in ("feature_al", "feature_s"):
        g = frame.groupby(list(SERIES), sort=False)[c]
        for k in (1, 3, 5, 10, 25):
            close(got[f"{c}_lag{k}"], g.shift(k))
        close(got[f"{c}_diff1"], g.diff(1))
        for n in (5, 10):
            close(got[f"{c}_roll{n}"], g.transform(lambda s, n=n: s.rolling(n, min_periods=1).mean()))
            close(got[f"{c}_rollstd{n}"], g.transform(lambda s, n=n: s.rolling(n, min_periods=1).std()))
        close(got[f"{c}_ewm5"], g.transform(lambda s: s.ewm(span=5, adjust=False).mean()))


@pytest.mark.parametrize("limit", [10**9, 1_000])
def test_research_lags_against_pandas(spark, frame, limit, monkeypatch):
    monkeypatch.setattr(series, "CHUNK_ROWS", 100)
    df = to_spark(spark, frame)
    config = rf.ResearchConfig(("feature_al", "feature_s"), ("feature_al",), (), stationarity_block=True)
    got = ordered(rf.lag_features(df, config, measure(df, limit)))
    g = frame.groupby(list(SERIES), sort=False)["feature_al"]
    for k in (1, 2, 3, 5, 10, 20, 40):
        close(got[f"feature_al_lag{k}"], g.shift(k))
    close(got["feature_al_mom_lag1_div_lag5"], g.shift(1) / (g.shift(5).abs() + 1e-4))
    for n in (5, 10, 20):
        close(got[f"feature_al_rmean{n}"], g.transform(lambda s, n=n: s.shift(1).rolling(n, min_periods=1).mean()))
        close(got[f"feature_al_rstd{n}"], g.transform(lambda s, n=n: s.shift(1).rolling(n, min_periods=1).std()))
    for span in (5, 10, 20):
        # Null inputs stay null in the lagged mean.
        mean = g.transform(lambda s, span=span: s.ewm(span=span, adjust=False).mean().where(s.notna()).shift(1))
        close(got[f"feature_al_ewm{span}"], mean)
    close(got["feature_al_diff_prev"], g.shift(1) - g.shift(2))


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("limit", [10**9, 1_000])
def test_fill_against_pandas(spark, frame, limit, forward):
    df = to_spark(spark, frame)
    got = ordered(series.fill_series(df, ["feature_al"], measure(df, limit), forward, chunk_rows=500))
    g = frame.groupby(list(SERIES), sort=False)["feature_al"]
    close(got["feature_al"], g.ffill() if forward else g.bfill())


def test_positions_and_chunks(spark, frame):
    df = to_spark(spark, frame)
    got = ordered(series.with_series_position(df))
    assert list(got["_pos"]) == list(frame.groupby(list(SERIES), sort=False).cumcount())
    chunked = series.chunk_series(df, look_back=7, look_ahead=3, chunk_rows=100)
    assert chunked.where("NOT _halo").count() == len(frame)
    largest = chunked.groupBy(*SERIES, "_chunk").count().agg({"count": "max"}).first()[0]
    assert largest <= 110


def test_known_ewm_values(spark):
    for values, policy, want in (
        ([1, None, 3], "carry", [1, 1, 1.857143]),
        ([1, None, 3], "null", [1, np.nan, 1.857143]),
        ([None, 2], "carry", [np.nan, 2]),
        ([1, None, 3, None, None, 10], "carry", [1, 1, 1.857143, 1.857143, 1.857143, 6.168067]),
    ):
        rows = [("C", "S", "K", 1, i, None if v is None else float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(
            rows, "code string, sub_code string, sub_category string, horizon int, ts_index int, feature_al double"
        )
        got = series.add_ewm(df, SERIES, ["feature_al"], [5], len(values), policy).orderBy("ts_index").toPandas()
        got = got["feature_al_ewm5"].astype(float)
        np.testing.assert_allclose(got, np.array(want, dtype=float), atol=1e-6)


def test_no_look_ahead(spark, train):
    """Changing later rows must not change earlier features."""
    from pyspark.sql import functions as F

    config = rf.raw_only(train)
    cut = 3000
    changed = train.withColumn("feature_al", F.when(F.col("ts_index") > cut, -F.col("feature_al") * 7).otherwise(F.col("feature_al")))
    early = F.col("ts_index") <= cut
    a = rf.research_features(train, config).where(early)
    b = rf.research_features(changed, config).where(early)
    assert a.exceptAll(b).count() == 0
    c = ctx.context_features(train).where(early)
    d = ctx.context_features(changed).where(early)
    assert c.exceptAll(d).count() == 0


def test_partitioning_does_not_matter(spark, train):
    few = train.select("id", *SERIES, "ts_index", "feature_al", "feature_cg").coalesce(1)
    config = rf.raw_only(few)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = rf.research_features(few, config).toPandas().sort_values("id").reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    many = rf.research_features(few.repartition(13), config).toPandas().sort_values("id").reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    pd.testing.assert_frame_equal(one, many, check_exact=False, rtol=1e-9, atol=1e-9)


def test_feature_block_shuffles(spark, train):
    """One exchange for all series windows, one for all cross-section windows."""
    config = rf.raw_only(train)
    sizes = measure(train)
    assert rf.lag_features(train, config, sizes)._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    plan = rf.research_features(train, config, sizes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 2
