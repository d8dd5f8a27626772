"""The horizon-mean baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.contract import VAL_RATIO
from panelyard.operators.scoring import score_by_horizon
from panelyard.operators.splits import split_at, time_split
from panelyard.sources.panel_io import small_side


def horizon_mean_predictions(fit: DataFrame, val: DataFrame) -> DataFrame:
    """Validation rows with the fit mean of their horizon; 0.0 for a horizon never seen."""
    means = fit.groupBy("horizon").agg(F.avg("y_target").alias("_mean"))
    joined = val.join(small_side(means, "horizon-means"), "horizon", "left")
    return joined.select(*val.columns, F.coalesce("_mean", F.lit(0.0)).alias("prediction"))


def horizon_mean_baseline(train: DataFrame, val_ratio: float = VAL_RATIO) -> DataFrame:
    """(horizon, skill, rows); horizon null is the overall score."""
    start = time_split(train, val_ratio)
    fit, val = split_at(train, start)
    return score_by_horizon(horizon_mean_predictions(fit, val))


def baseline_summary(train: DataFrame, val_ratio: float = VAL_RATIO) -> dict:
    """Split step, overall score and row counts of the baseline."""
    start = time_split(train, val_ratio)
    fit, val = split_at(train, start)
    overall = score_by_horizon(horizon_mean_predictions(fit, val)).where("horizon IS NULL").first()
    counts = train.agg(F.count_if(F.col("ts_index") < start).alias("fit")).first()
    return {
        "baseline": "horizon_mean",
        "split_ts": start,
        "final_metric": float(overall["skill"]),
        "rows_fit": int(counts["fit"]),
        "rows_val": int(overall["rows"]),
    }
