"""Names, domains and fixed numbers every operator agrees on."""

from __future__ import annotations

# --- fixed values: the panel data model -------------------------------------
KEY_COLUMNS = ("code", "sub_code", "sub_category", "horizon", "ts_index")
SERIES = ("code", "sub_code", "sub_category", "horizon")
SECTION = ("horizon", "ts_index")
CATEGORIES = ("code", "sub_code", "sub_category")
TRAIN_REQUIRED = ("id", *KEY_COLUMNS, "weight", "y_target")
TEST_REQUIRED = ("id", *KEY_COLUMNS)
TEST_FORBIDDEN = ("y_target",)
META_COLUMNS = ("id", "y_target", "weight")
HORIZONS = (1, 3, 10, 25)
FEATURE_PREFIX = "feature_"

# --- fixed values: research features ----------------------------------------
RESEARCH_LAGS = (1, 2, 3, 5, 10, 20, 40)
RESEARCH_WINDOWS = (5, 10, 20)
RESEARCH_SPANS = (5, 10, 20)
RESEARCH_EPS = 1e-4
MAX_LAG_COLUMNS = 10
MAX_CROSS_COLUMNS = 6
MISSING_INDICATOR_RATE = 0.2
HIERARCHY_LEVELS = (("subcat", "sub_category"), ("code", "code"), ("subcode", "sub_code"))

# --- fixed values: context features of the two-level stack -------------------
CONTEXT_SIGNALS = ("feature_al", "feature_am", "feature_cg", "feature_by", "feature_s")
CONTEXT_LAGS = (1, 3, 5, 10, 25)
CONTEXT_WINDOWS = (5, 10)
CONTEXT_SPAN = 5
CONTEXT_RATIO_EPS = 1e-7
CONTEXT_Z_EPS = 1e-6
CYCLE_LENGTH = 100.0

# --- fixed values: splits and the stack --------------------------------------
VAL_RATIO = 0.15
N_FOLDS = 3
FOLD_VAL_SIZE = 180
FOLD_MIN_TRAIN = 800
LEVEL1_THRESHOLD = 3500
META_THRESHOLD = 3550
INNER_VAL_SIZE = 120
RIDGE_ALPHA = 2.0
MIN_ROUNDS = 50
CANDIDATES = ("lgb", "xgb", "mean", "meta_ridge")
LEVEL2_COLUMNS = (
    "pred_lgb",
    "pred_xgb",
    "pred_mean",
    "pred_diff",
    "pred_abs_diff",
    "pred_min",
    "pred_max",
    "ts_index",
    "sub_category_enc",
    "sub_code_enc",
    "t_cycle_sin",
    "t_cycle_cos",
)


def feature_columns(df) -> list[str]:
    """Raw numeric features, found by prefix, in alphabetical order."""
    return sorted(c for c in df.columns if c.startswith(FEATURE_PREFIX))
