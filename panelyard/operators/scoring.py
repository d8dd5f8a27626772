"""Scores, candidate comparison and blending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.contract import CANDIDATES, MIN_ROUNDS
from panelyard.functions.metrics import weighted_skill
from panelyard.sources.panel_io import small_side


def score(df: DataFrame, by: Sequence[str] = (), y="y_target", prediction="prediction", weight="weight"):
    """(by..., skill, rows)."""
    return df.groupBy(*by).agg(
        weighted_skill(y, prediction, weight).alias("skill"), F.count(F.lit(1)).alias("rows")
    )


def score_by_horizon(df: DataFrame, y="y_target", prediction="prediction", weight="weight") -> DataFrame:
    """Per horizon and overall (horizon null) in one pass."""
    return df.groupingSets([[F.col("horizon")], []], F.col("horizon")).agg(
        weighted_skill(y, prediction, weight).alias("skill"), F.count(F.lit(1)).alias("rows")
    )


def candidates_long(df: DataFrame, names: Sequence[str] = CANDIDATES, prefix: str = "pred_") -> DataFrame:
    """One row per candidate: (..., candidate, position, prediction). Position is the tie order."""
    kept = [c for c in df.columns if c not in {f"{prefix}{n}" for n in names}]
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("candidate"), F.lit(i).alias("position"), F.col(f"{prefix}{n}").alias("prediction")
            )
            for i, n in enumerate(names)
        ]
    )
    return df.select(*kept, F.inline(rows))


def candidate_scores(df: DataFrame, names: Sequence[str] = CANDIDATES, prefix: str = "pred_") -> DataFrame:
    """(horizon, candidate, position, skill): all candidates side by side."""
    return score(candidates_long(df, names, prefix), ["horizon", "candidate", "position"]).drop("rows")


def select_candidate(scores: DataFrame) -> DataFrame:
    """(horizon, candidate, skill): the best candidate; the first one listed wins a tie."""
    best = F.max_by(F.struct("candidate", "skill"), F.struct("skill", (-F.col("position")).alias("p")))
    return (
        scores.groupBy("horizon")
        .agg(best.alias("best"))
        .select("horizon", F.col("best.candidate").alias("candidate"), F.col("best.skill").alias("skill"))
    )


def apply_selection(df: DataFrame, selected: DataFrame, names=CANDIDATES, prefix: str = "pred_") -> DataFrame:
    """Add `prediction`: the column of the candidate chosen for the row's horizon.

    Every row stays: one whose horizon has no selection, or an unknown candidate, fails the job.
    """
    chosen = small_side(selected.select("horizon", "candidate"), "selected")
    joined = df.join(chosen, "horizon", "left")
    lost = F.raise_error(F.concat(F.lit("no selected candidate for horizon "), F.coalesce(F.col("horizon").cast("string"), F.lit("null"))))
    value: Column = F.when(F.coalesce(~F.col("candidate").isin(*names), F.lit(True)), lost.cast("double"))
    for n in names:
        value = value.when(F.col("candidate") == n, F.col(f"{prefix}{n}"))
    return joined.withColumn("prediction", value)


def mean_of_members(columns: Sequence[str]) -> Column:
    """Row-wise ensemble mean of member columns; null where a member is missing."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / len(columns)


def ensemble_mean(members: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Mean over members held as rows."""
    return members.groupBy(*keys).agg(F.avg("prediction").alias("prediction"))


def best_rounds(per_fold: DataFrame, num_boost_round: int) -> DataFrame:
    """(horizon, tag, rounds): median over folds, cut to int; a quarter of the budget without any."""
    fallback = max(MIN_ROUNDS, num_boost_round // 4)
    # One value per fold and tag: the group is as large as the number of folds.
    return per_fold.groupBy("horizon", "tag").agg(
        F.coalesce(F.median("best_iteration").cast("int"), F.lit(fallback)).alias("rounds")
    )


def choose_rounds(per_fold: DataFrame, default_rounds: int) -> DataFrame:
    """One number of rounds for all folds: median cut to int, at least 50."""
    middle = F.median("best_iteration").cast("int")
    return per_fold.agg(
        F.when(F.count("best_iteration") == 0, F.lit(default_rounds))
        .otherwise(F.greatest(F.lit(MIN_ROUNDS), middle))
        .alias("rounds")
    )


def level2_frame(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The twelve level-2 inputs from two predictions and their context; absent context is 0."""
    a, b = F.col("pred_lgb"), F.col("pred_xgb")
    both = a.isNotNull() & b.isNotNull()

    def context(c: str) -> Column:
        return (F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c)

    return df.select(
        *keep,
        a,
        b,
        ((a + b) / 2.0).alias("pred_mean"),
        (a - b).alias("pred_diff"),
        F.abs(a - b).alias("pred_abs_diff"),
        F.when(both, F.least(a, b)).alias("pred_min"),
        F.when(both, F.greatest(a, b)).alias("pred_max"),
        F.col("ts_index").cast("double").alias("ts_index"),
        *[context(c) for c in ("sub_category_enc", "sub_code_enc", "t_cycle_sin", "t_cycle_cos")],
    )


def align_predictions(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows with their prediction by `id`; a row without one fails the job."""
    joined = rows.join(predictions.select("id", "prediction"), "id", "left")
    checked = F.when(
        F.col("prediction").isNull(), F.raise_error(F.concat(F.lit("missing prediction for id "), "id")).cast("double")
    ).otherwise(F.col("prediction"))
    return joined.withColumn("prediction", checked)
