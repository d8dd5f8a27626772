from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.models import boosting
from panelyard.models.categories import fit_coder, plan_categories
from panelyard.models.ridge import fit_ridge
from panelyard.operators import scoring
from panelyard.operators import research_features as rf
from panelyard.plans import stack, validation, walk_forward
from panelyard.sources import star_panel

TREES = dict(max_depth=2, learning_rate=0.3, min_leaf_rows=20)


def skill(y, p, w):
    power = np.sum(w * y * y)
    return 0.0 if power <= 0 else float(np.sqrt(1 - np.clip(np.sum(w * (y - p) ** 2) / power, 0, 1)))


def test_skill_edge_cases(spark):
    rng = np.random.default_rng(0)
    cases = [rng.normal(size=(3, 50)), np.zeros((3, 4)), np.array([[1.0], [9.0], [1.0]])]
    for y, p, w in cases:
        w = np.abs(w)
        df = spark.createDataFrame(pd.DataFrame({"y_target": y, "prediction": p, "weight": w}))
        assert scoring.score(df).first()["skill"] == pytest.approx(skill(y, p, w), abs=1e-12)


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = rng.normal(size=(n, 3)) * [1, 50, 0.1] + [0, 10, 3]
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.full(n, 4.0)])  # collinear and constant columns
    y, w = x[:, 0] * 2 - x[:, 1] * 0.1 + rng.normal(size=n), rng.random(n) * 5
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y, w=w))
    model = fit_ridge(df, names, "y", "w")
    sd = x.std(axis=0)
    sd[sd < 1e-12] = 1
    z = (x - x.mean(axis=0)) / sd
    zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
    b = np.linalg.solve((zc * w[:, None]).T @ zc + 2.0 * np.eye(5), (zc * w[:, None]).T @ yc)
    # Along the collinear direction only the penalty fixes the coefficients.
    np.testing.assert_allclose(model.coefficients, b, atol=1e-6)
    got = df.select(model.expression().alias("p")).toPandas()["p"].to_numpy()
    want = (z - np.average(z, axis=0, weights=w)) @ b + np.average(y, weights=w)
    np.testing.assert_allclose(got, want, atol=1e-7)


def noisy(spark, n=1500, seed=2):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": [str(i) for i in range(n)], "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["y_target"] = np.sign(pdf["a"]) + rng.normal(size=n) * 2
    pdf["weight"] = rng.random(n) + 0.5
    frame = boosting.training_frame(spark.createDataFrame(pdf), ["a", "b"], ["id"])
    return boosting.pinned(frame, 4).persist()


def test_best_round_and_reproducibility(spark):
    df = noisy(spark)
    fit, val = df.where("id % 2 = 0").persist(), df.where("id % 2 = 1")
    params = replace(boosting.BASELINE, max_depth=5, learning_rate=0.8, min_leaf_rows=5)
    model, best = boosting.fit_with_validation(fit, val, params, 12, seed=3)
    assert 1 <= best < 12 and len(model.trees) == best
    full = boosting.fit_rounds(fit, params, 12, seed=3)
    errors = full.evaluateEachIteration(val, "squared")
    assert best == int(np.argmin(errors)) + 1
    # The refit is the first part of the long model.
    assert model.evaluateEachIteration(val, "squared") == pytest.approx(errors[:best])
    assert boosting.probe_rounds(fit, val, params, 12, 3, min_rounds=10) == 10
    with pytest.raises(ValueError):
        boosting.with_objective(params, "poisson")
    huber = boosting.fit_rounds(fit, boosting.with_objective(params, "huber"), 12, 3)
    assert huber.coefficients[0] > 0


def test_category_coding(spark):
    rows = [(f"c{i % 3}", f"s{i}", float(i % 3)) for i in range(60)] + [(None, "s0", 7.0)]
    df = spark.createDataFrame(rows, "code string, sub_code string, y_target double")
    unseen = spark.createDataFrame([("new", "new", 0.0)], df.schema)
    overall = sum(r[2] for r in rows) / len(rows)
    coder = fit_coder(df, plan_categories(df, ["code", "sub_code"]))
    out = coder.apply(df.unionByName(unseen)).collect()
    assert {r["code_idx"] for r in out if r["code"] is None} == {7.0}
    assert all(r["code_idx"] == r["y_target"] for r in out if r["code"] in ("c0", "c1", "c2"))
    assert [(r["code_idx"], r["sub_code_idx"]) for r in out if r["code"] == "new"] == [(overall, overall)]
    labels = fit_coder(df, plan_categories(df, ["code", "sub_code"], labelled=["code"])).apply(unseen).first()
    assert labels["code_idx"] == 3.0 and labels["sub_code_idx"] == overall


def test_category_coding_is_the_same_at_every_size(spark):
    for values in (5, 5000):
        df = spark.range(values).selectExpr("CAST(id AS string) AS code", "CAST(id AS double) AS y_target")
        plan = plan_categories(df, ["code"])
        assert plan.wide == ("code",) and plan.indexer is None


def test_selection_keeps_every_row_or_fails(spark):
    rows = spark.createDataFrame([(1, 0.1, 0.2), (3, 0.3, 0.4)], "horizon int, pred_lgb double, pred_xgb double")
    chosen = spark.createDataFrame([(1, "xgb")], "horizon int, candidate string")
    picked = scoring.apply_selection(rows.where("horizon = 1"), chosen, names=("lgb", "xgb"))
    assert [r["prediction"] for r in picked.collect()] == [0.2]
    with pytest.raises(Exception, match="no selected candidate"):
        scoring.apply_selection(rows, chosen, names=("lgb", "xgb")).collect()


def test_selection_prefers_the_first_on_ties(spark):
    rows = [(1, "lgb", 0, 0.5), (1, "xgb", 1, 0.5), (3, "lgb", 0, 0.1), (3, "mean", 2, 0.9)]
    chosen = scoring.select_candidate(spark.createDataFrame(rows, "horizon int, candidate string, position int, skill double"))
    assert {r["horizon"]: r["candidate"] for r in chosen.collect()} == {1: "lgb", 3: "mean"}


def test_missing_prediction_fails(spark, test_rows):
    some = test_rows.select("id", F.lit(1.0).alias("prediction")).limit(5)
    with pytest.raises(Exception, match="missing prediction"):
        scoring.align_predictions(test_rows, some).collect()


@pytest.fixture(scope="module")
def two_horizons(train, test_rows):
    keep = F.col("horizon").isin(1, 25)
    return train.where(keep), test_rows.where(keep)


def test_stack_predicts_every_test_row_once(spark, two_horizons, tmp_path):
    train, test = two_horizons
    config = stack.StackConfig(
        level1_threshold=star_panel.LEVEL1_THRESHOLD, meta_threshold=star_panel.META_THRESHOLD,
        lgb_seeds=(1, 2), xgb_seeds=(1,), lgb_rounds=3, xgb_rounds=3, xgb_min_rounds=2,
        lgb=replace(boosting.FAMILY_LGB, **TREES), xgb=replace(boosting.FAMILY_XGB, **TREES), fit_partitions=4,
    )
    result = stack.run_stack(train, test, config)
    stack.write_stack(result, test, config, str(tmp_path))  # checks the ids
    best = result.scores.toPandas().sort_values(["skill", "position"], ascending=[False, True]).groupby("horizon").first()
    rows = {r["horizon"]: r for r in result.horizon_results.collect()}
    assert {h: r["selected_model"] for h, r in rows.items()} == best["candidate"].to_dict()
    assert len(rows[1]["best_iterations_lgb"].split(",")) == 2
    assert 0 < result.final_eval_score < 1
    assert spark.read.csv(f"{tmp_path}/validation_by_horizon", header=True).count() == 2
    with pytest.raises(ValueError):
        stack.run_stack(train, test, replace(config, meta_threshold=9_999))


def test_walk_forward_and_final_fit(spark, two_horizons):
    train, test = two_horizons
    limits = rf.FeatureLimits(2, 1, switches=dict(lags=(1, 5), windows=(5,), spans=(5,)))
    settings = walk_forward.CVSettings(
        params=replace(boosting.WALK_FORWARD, **TREES), objectives=("regression", "regression_l1"), seeds=(42,),
        n_folds=2, rounds=2, limits=limits, fit_partitions=4,
    )
    outcome = walk_forward.walk_forward_cv(train, settings)
    cache = outcome.cache.toPandas()
    assert not cache.duplicated(["id", "fold"]).any() and cache["pred"].notna().all()
    for (h, f), part in cache.groupby(["horizon", "fold"]):
        row = outcome.fold_scores.where((F.col("horizon") == h) & (F.col("fold") == f)).first()
        assert part["ts_index"].between(row["val_start_ts"], row["val_end_ts"]).all()
        assert row["skill"] == pytest.approx(skill(part["y"], part["pred"], part["wt"]), abs=1e-9)
    assert outcome.final_metric == pytest.approx(skill(cache["y"], cache["pred"], cache["wt"]), abs=1e-9)
    assert set(outcome.best_iterations[1]) == {"regression_s42", "regression_l1_s42"}
    summary = outcome.summary(settings)
    assert set(summary["best_iterations"]) == {"1", "25"}
    fit = walk_forward.fit_predict_ensemble(train, test, settings, outcome.best_iterations, outcome.configs)
    got = fit.predictions.toPandas()
    assert sorted(got["id"]) == sorted(r["id"] for r in test.select("id").collect()) and got["prediction"].notna().all()
    assert fit.info[25]["models"][0]["rounds"] == outcome.best_iterations[25]["regression_s42"]


def test_per_horizon_models(spark, two_horizons):
    train, test = two_horizons
    settings = validation.FitSettings(params=replace(boosting.BASELINE, **TREES), rounds=2, fit_partitions=4)
    outcome = validation.per_horizon_validation(train, settings)
    assert set(outcome.best_iterations) == {1, 25}
    oof = outcome.out_of_fold.toPandas()
    assert oof["ts_index"].min() == outcome.split_ts
    models = validation.fit_per_horizon_full(train.where("horizon = 1"), settings, {1: 2})
    assert validation.predict_per_horizon(models, test.where("horizon = 1")).count() == test.where("horizon = 1").count()
    with pytest.raises(ValueError, match="25"):
        validation.predict_per_horizon(models, test)


def test_partitions_of_a_training_frame_grow_with_its_rows(spark, monkeypatch):
    frame = spark.range(100).select(F.col("id").cast("string").alias("id"))
    assert boosting.pinned(frame, 4).rdd.getNumPartitions() == 4
    monkeypatch.setattr(boosting, "PINNED_ROWS", 10)
    assert boosting.pinned(frame, 4).rdd.getNumPartitions() == 10
