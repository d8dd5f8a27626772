"""SQL that computes each registered query independently, over the same parquet tables."""

from __future__ import annotations

from catalog.rounding import OFF_TIE, places

PANEL = """
daily AS (
  SELECT l_suppkey, l_returnflag,
         CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS ts_index,
         sum(l_quantity) AS feature_al, max(l_extendedprice) AS feature_am, min(l_discount) AS feature_by,
         max(CASE WHEN l_linenumber <= 2 THEN l_extendedprice END) AS feature_cg,
         CAST(count(*) AS DOUBLE) AS feature_s, max(l_extendedprice) / 1000 AS weight
  FROM lineitem GROUP BY ALL),
signals AS (
  SELECT 'C' || CAST(s_nationkey AS VARCHAR) AS code, 'S' || CAST(l_suppkey AS VARCHAR) AS sub_code,
         'K' || l_returnflag AS sub_category, d.* EXCLUDE (l_suppkey, l_returnflag)
  FROM daily d JOIN supplier ON l_suppkey = s_suppkey),
ahead AS (
  SELECT *,
    avg(feature_al) OVER (w ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS a1,
    avg(feature_al) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a3,
    avg(feature_al) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS a10,
    avg(feature_al) OVER (w ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING) AS a25
  FROM signals WINDOW w AS (PARTITION BY code, sub_code, sub_category ORDER BY ts_index)),
panel AS (
  SELECT code || '_' || sub_code || '_' || sub_category || '_' || CAST(horizon AS VARCHAR) || '_'
           || CAST(ts_index AS VARCHAR) AS id,
         code, sub_code, sub_category, horizon, ts_index, weight,
         coalesce(CASE horizon WHEN 1 THEN a1 WHEN 3 THEN a3 WHEN 10 THEN a10 ELSE a25 END - feature_al, 0.0)
           AS y_target,
         feature_al, feature_am, feature_by, feature_cg, feature_s
  FROM ahead CROSS JOIN (VALUES (1), (3), (10), (25)) h(horizon)),
train AS (SELECT * FROM panel WHERE ts_index < 3420),
test AS (SELECT * EXCLUDE (y_target) FROM panel WHERE ts_index >= 3420),
base AS (SELECT * FROM train WHERE ts_index <= 3250)
"""

FEATURES = ("feature_al", "feature_am", "feature_by", "feature_cg", "feature_s")
PAIR = ("feature_al", "feature_cg")
SERIES = "code, sub_code, sub_category, horizon"
W = f"(PARTITION BY {SERIES} ORDER BY ts_index"


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {OFF_TIE!r}, {places(name)}) AS {name}"


def rs(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)


def q(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {PANEL} {', ' + more if more else ''} {body}"


def lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER {W})"


def frame(f: str, c: str, lo: str, hi: str) -> str:
    return f"{f}({c}) OVER {W} ROWS BETWEEN {lo} AND {hi})"


SKILL = """CASE WHEN sum({w} * y_target * y_target) > 0
 THEN sqrt(1 - least(greatest(sum({w} * (y_target - {p}) * (y_target - {p})) / sum({w} * y_target * y_target), 0), 1))
 ELSE 0 END"""


def skill(p: str = "prediction", w: str = "weight") -> str:
    return r(SKILL.format(p=p, w=w), "skill")


STEPS = """
steps AS (SELECT horizon, ts_index, row_number() OVER (PARTITION BY horizon ORDER BY ts_index) - 1 AS pos,
                 count(*) OVER (PARTITION BY horizon) AS n
          FROM (SELECT DISTINCT horizon, ts_index FROM train))
"""
FOLDS = STEPS + """,
starts AS (SELECT horizon, i + 1 AS fold, greatest(n - 540, 900) + i * 180 AS a, n
           FROM (SELECT DISTINCT horizon, n FROM steps) CROSS JOIN (VALUES (0), (1), (2)) f(i)),
folds AS (SELECT s.horizon, CAST(s.fold AS INTEGER) AS fold, e.ts_index AS train_end_ts, b.ts_index AS val_start_ts,
                 v.ts_index AS val_end_ts
          FROM starts s JOIN steps e ON e.horizon = s.horizon AND e.pos = s.a - 1
          JOIN steps b ON b.horizon = s.horizon AND b.pos = s.a
          JOIN steps v ON v.horizon = s.horizon AND v.pos = least(s.a + 179, s.n - 1)),
members AS (SELECT t.*, f.fold, CASE WHEN t.ts_index < f.val_start_ts THEN 'fit' ELSE 'val' END AS role
            FROM train t JOIN folds f ON t.horizon = f.horizon AND t.ts_index <= f.val_end_ts)
"""

SCORED = "scored AS (SELECT *, y_target * 0.5 + feature_am / 10000 - feature_s AS prediction FROM train)"

STRATA = """
strata AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY md5(id || '|42'), id) AS rn FROM train),
quota AS (SELECT horizon, 500 + CASE WHEN row_number() OVER (ORDER BY horizon) <= 2 THEN 1 ELSE 0 END AS quota
          FROM (SELECT DISTINCT horizon FROM train)),
drawn AS (SELECT s.* EXCLUDE (rn) FROM strata s JOIN quota USING (horizon) WHERE rn <= quota)
"""

ENCODED = """
enc_cat AS (SELECT horizon, sub_category, avg(y_target) AS m FROM base GROUP BY ALL),
enc_code AS (SELECT horizon, sub_code, avg(y_target) AS m FROM base GROUP BY ALL),
enc_all AS (SELECT horizon, avg(y_target) AS m FROM base GROUP BY ALL)
"""
TWO = ENCODED + """,
two AS (
  SELECT x.*, coalesce(c.m, a.m) AS sub_category_enc, coalesce(s.m, a.m) AS sub_code_enc,
         coalesce(s.m, a.m) AS pred_lgb, coalesce(c.m, a.m) - x.feature_al / 2 AS pred_xgb
  FROM train x JOIN enc_all a USING (horizon) LEFT JOIN enc_cat c USING (horizon, sub_category)
  LEFT JOIN enc_code s USING (horizon, sub_code) WHERE x.ts_index > 3335)
"""
CANDIDATES = TWO + """,
cand AS (SELECT *, (pred_lgb + pred_xgb) / 2 AS pred_mean, pred_lgb * 0.75 + pred_xgb * 0.25 AS pred_meta_ridge
         FROM two),
long AS (SELECT horizon, weight, y_target, id, unnest(['lgb', 'xgb', 'mean', 'meta_ridge']) AS candidate,
                unnest([0, 1, 2, 3]) AS position,
                unnest([pred_lgb, pred_xgb, pred_mean, pred_meta_ridge]) AS prediction FROM cand),
scores AS (SELECT horizon, candidate, position, {skill} FROM long GROUP BY horizon, candidate, position),
best AS (SELECT horizon, arg_max(candidate, (skill, -position)) AS candidate, max(skill) AS skill
         FROM scores GROUP BY horizon)
""".replace("{skill}", SKILL.format(p="prediction", w="weight") + " AS skill")


def ewm_cte(spans, columns) -> str:
    """Row-by-row recurrence over all series at once, one step per recursion."""
    first, step = [], []
    for c in columns:
        first.append(f"CAST(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS BIGINT) AS g_{c}")
        step.append(
            f"CASE WHEN p.{c} IS NOT NULL THEN 1 WHEN e.g_{c} = 0 THEN 0 ELSE e.g_{c} + 1 END AS g_{c}"
        )
        for s in spans:
            alpha = 2.0 / (s + 1)
            keep = 1.0 - alpha
            first.append(f"{c} AS y_{c}_{s}")
            step.append(
                f"CASE WHEN p.{c} IS NULL THEN e.y_{c}_{s} WHEN e.y_{c}_{s} IS NULL THEN p.{c} "
                f"ELSE (pow({keep!r}, e.g_{c}) * e.y_{c}_{s} + {alpha!r} * p.{c}) / (pow({keep!r}, e.g_{c}) + {alpha!r}) "
                f"END AS y_{c}_{s}"
            )
    return f"""
numbered AS MATERIALIZED (
  SELECT id, {SERIES}, {', '.join(columns)}, row_number() OVER {W}) AS rn FROM panel),
walk AS (
  SELECT id, {SERIES}, rn, {', '.join(columns)}, {', '.join(first)} FROM numbered WHERE rn = 1
  UNION ALL
  SELECT p.id, p.code, p.sub_code, p.sub_category, p.horizon, p.rn, {', '.join('p.' + c for c in columns)},
         {', '.join(step)}
  FROM walk e JOIN numbered p ON p.rn = e.rn + 1 AND p.sub_code = e.sub_code AND p.sub_category = e.sub_category
       AND p.code = e.code AND p.horizon = e.horizon)
"""


def _ranks(c: str) -> str:
    section = "PARTITION BY horizon, ts_index"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER ({section} ORDER BY {c} ASC NULLS LAST)"
        f" + (count(*) OVER ({section}, {c}) - 1) / 2.0) / count(*) OVER ({section}) END"
    )


def _level(c: str, key: str) -> str:
    return f"avg({c}) OVER (PARTITION BY horizon, ts_index, {key})"


LEVELS = (("subcat", "sub_category"), ("code", "code"), ("subcode", "sub_code"))


def _z(c: str, spread: str) -> str:
    section = "(PARTITION BY horizon, ts_index)"
    return f"({c} - avg({c}) OVER {section}) / ({spread.format(std=f'stddev_samp({c}) OVER {section}')})"


def _nearest(p: float) -> str:
    return f"max(CASE WHEN rn = 1 + round({p} * (n - 1)) THEN y_target END)"


def _median_rows(columns, source: str) -> str:
    """(level, sub_category, column, value) for overall and per-category medians."""
    parts = []
    for c in columns:
        parts.append(f"SELECT 'all' AS level, NULL AS sub_category, '{c}' AS \"column\", median({c}) AS value FROM {source}")
        parts.append(f"SELECT 'sub_category', sub_category, '{c}', median({c}) FROM {source} GROUP BY sub_category")
    return " UNION ALL ".join(parts)


NUMERIC = ("horizon", "ts_index", *FEATURES, "feature_cg_isna")


def _filled(source: str, absent=()) -> str:
    columns = []
    for c in NUMERIC:
        own = "NULL" if c in absent else f"CAST(x.{c} AS DOUBLE)"
        columns.append(r(f"coalesce({own}, m.{c}, a.{c}, 0)", c))
    inner = ", ".join(f"median({c}) AS {c}" for c in NUMERIC)
    return q(
        f"SELECT x.id, {', '.join(columns)}, x.code, x.sub_code, x.sub_category "
        f"FROM (SELECT *, CASE WHEN feature_cg IS NULL THEN 1 ELSE 0 END AS feature_cg_isna FROM {source}) x "
        "LEFT JOIN per_cat m ON m.sub_category = x.sub_category CROSS JOIN overall a",
        "fitrows AS (SELECT *, CASE WHEN feature_cg IS NULL THEN 1 ELSE 0 END AS feature_cg_isna FROM train), "
        f"per_cat AS (SELECT sub_category, {inner} FROM fitrows GROUP BY sub_category), "
        f"overall AS (SELECT {inner} FROM fitrows)",
    )


def _missing_rates(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 'missing_rate')} FROM {source}"
        for c in FEATURES
    )


def _check(check: str, table: str, n: str, detail: str, source: str) -> str:
    return (
        f"SELECT '{check}' AS \"check\", '{table}' AS \"table\", {n} = 0 AS ok, CAST({n} AS BIGINT) AS n_bad, "
        f"CAST({detail} AS VARCHAR) AS detail FROM {source}"
    )


def _report(train: str, test: str, forbidden: int, more: str = "") -> str:
    parts = [
        f"SELECT 'required_columns' AS \"check\", '{t}' AS \"table\", true AS ok, CAST(0 AS BIGINT) AS n_bad, '' AS detail"
        for t in ("train", "test")
    ]
    name = "y_target" if forbidden else ""
    parts.append(f"SELECT 'forbidden_columns', 'test', {forbidden} = 0, {forbidden}, '{name}'")
    for label, table in (("train", train), ("test", test)):
        for check, keys in (("unique_id", "id"), ("unique_key", f"{SERIES}, ts_index")):
            repeated = f"(SELECT count(*) AS n FROM (SELECT {keys} FROM {table} GROUP BY ALL HAVING count(*) > 1))"
            parts.append(_check(check, label, "n", "CAST(n AS VARCHAR) || ' repeated values'", repeated))
        parts.append(
            _check(
                "horizon_domain", label, "n", "d",
                f"(SELECT count(*) AS n, coalesce(max(CAST(horizon AS VARCHAR)), '') AS d FROM {table} "
                "WHERE horizon NOT IN (1, 3, 10, 25))",
            )
        )
    parts.append(
        _check(
            "temporal_boundary", "both", "CASE WHEN a < b THEN 0 ELSE 1 END",
            "CAST(a AS VARCHAR) || ' -> ' || CAST(b AS VARCHAR)",
            f"(SELECT (SELECT max(ts_index) FROM {train}) AS a, (SELECT min(ts_index) FROM {test}) AS b)",
        )
    )
    return q(" UNION ALL ".join(parts), more)


ROUNDED_PANEL = (
    f"id, code, sub_code, sub_category, horizon, ts_index, {rs('weight', 'y_target', *FEATURES)}"
)
ROUNDED_TEST = f"id, code, sub_code, sub_category, horizon, ts_index, {rs('weight', *FEATURES)}"
SERIES_ORDER = "code, sub_code, sub_category, horizon, ts_index"

ORACLES = {
    "panel_rows": q(f"SELECT {ROUNDED_PANEL} FROM panel"),
    "horizon_scan": q(f"SELECT {ROUNDED_PANEL} FROM train WHERE horizon = 10"),
    "capped_train_tail": q(
        f"SELECT {ROUNDED_PANEL} FROM train WHERE horizon = 3 ORDER BY code DESC, sub_code DESC, "
        "sub_category DESC, horizon DESC, ts_index DESC LIMIT 500"
    ),
    "capped_test_head": q(f"SELECT {ROUNDED_TEST} FROM test WHERE horizon = 3 ORDER BY {SERIES_ORDER} LIMIT 200"),
    "prediction_mismatches": q("SELECT id, 'missing' AS problem FROM test WHERE horizon < 10"),
    "column_overview": q(
        "SELECT 'feature_count' AS item, CAST(count(*) FILTER (column_name LIKE 'feature_%') AS VARCHAR) AS value "
        "FROM (DESCRIBE SELECT * FROM train) "
        "UNION ALL SELECT 'first_features', string_agg(column_name, ',' ORDER BY column_name) "
        "FROM (DESCRIBE SELECT * FROM train) WHERE column_name LIKE 'feature_%' "
        "UNION ALL SELECT 'train_only', 'y_target' UNION ALL SELECT 'test_only', ''"
    ),
    "validate_report": _report("train", "test", 0),
    "repeated_rows_report": _report(
        "both_train", "late", 1,
        "late AS (SELECT * FROM train WHERE ts_index >= 3335), "
        "both_train AS (SELECT * FROM train UNION ALL BY NAME "
        "SELECT * REPLACE (7 AS horizon) FROM late WHERE horizon = 25)",
    ),
    "time_split": q(
        "SELECT horizon, any_value(start) AS val_start_ts, count(*) FILTER (ts_index < start) AS rows_fit, "
        "count(*) FILTER (ts_index >= start) AS rows_val FROM train CROSS JOIN cut GROUP BY horizon",
        "cut AS (SELECT ts_index AS start FROM (SELECT ts_index, row_number() OVER (ORDER BY ts_index) - 1 AS pos, "
        "count(*) OVER () AS n FROM (SELECT DISTINCT ts_index FROM train)) "
        "WHERE pos = greatest(1, least(floor((1 - 0.15) * n), n - 1)))",
    ),
    "walk_forward_folds": q("SELECT * FROM folds", FOLDS),
    "fold_membership": q(
        f"SELECT horizon, fold, role, count(*) AS rows, min(ts_index) AS min_ts, max(ts_index) AS max_ts, "
        f"{r('avg(y_target)', 'target_mean')} FROM members GROUP BY horizon, fold, role",
        FOLDS,
    ),
    "segments": q(
        "SELECT horizon, CASE WHEN ts_index <= 3250 THEN 'base' WHEN ts_index <= 3335 THEN 'meta' ELSE 'eval' END "
        f"AS segment, count(*) AS rows, min(ts_index) AS min_ts, max(ts_index) AS max_ts, "
        f"{r('avg(weight)', 'weight_mean')} FROM train GROUP BY horizon, segment"
    ),
    "inner_split": q(
        "SELECT b.horizon, b.ts_index >= c.cutoff AS is_val, count(*) AS rows, min(b.ts_index) AS min_ts, "
        "max(b.ts_index) AS max_ts FROM base b JOIN cutoffs c USING (horizon) GROUP BY b.horizon, is_val",
        "cutoffs AS (SELECT horizon, ts_index AS cutoff FROM (SELECT horizon, ts_index, row_number() OVER "
        "(PARTITION BY horizon ORDER BY ts_index DESC) AS rn FROM (SELECT DISTINCT horizon, ts_index FROM base)) "
        "WHERE rn = 120)",
    ),
    "stratified_sample": q("SELECT id, horizon, ts_index FROM drawn", STRATA),
    "plain_sample": q("SELECT id, horizon, ts_index FROM train ORDER BY md5(id || '|42'), id LIMIT 1000"),
    "missing_in_sample": q(
        _missing_rates("s"), "s AS (SELECT * FROM train ORDER BY md5(id || '|42'), id LIMIT 10000)"
    ),
    "horizon_profile": q(
        "SELECT horizon, count(*) AS rows, min(ts_index) AS min_ts, max(ts_index) AS max_ts, "
        f"{r('avg(y_target)', 'target_mean')}, {r('stddev_samp(y_target)', 'target_std')}, "
        f"{r('avg(weight)', 'weight_mean')} FROM train GROUP BY horizon"
    ),
    "test_profile": q(
        "SELECT horizon, count(*) AS rows, min(ts_index) AS min_ts, max(ts_index) AS max_ts FROM test GROUP BY horizon"
    ),
    "target_quantiles": q(
        f"SELECT horizon, {r(_nearest(0.01), 'q01')}, {r(_nearest(0.10), 'q10')}, {r('median(y_target)', 'q50')}, "
        f"{r(_nearest(0.90), 'q90')}, {r(_nearest(0.99), 'q99')} FROM ranked GROUP BY horizon",
        "ranked AS (SELECT horizon, y_target, row_number() OVER (PARTITION BY horizon ORDER BY y_target) AS rn, "
        "count(*) OVER (PARTITION BY horizon) AS n FROM train)",
    ),
    "missing_top20": q(_missing_rates("train")),
    "feature_ranking": q(
        f"SELECT feature, {rs('missing_rate')}, {r('ln(variance)', 'log_variance')}, {r('ln(stability)', 'log_stability')} "
        "FROM stats ORDER BY stability DESC, feature LIMIT 3",
        "stats AS (SELECT feature, missing_rate, variance, variance * greatest(0, 1 - missing_rate) AS stability FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate, "
            f"coalesce(var_samp({c}), 0) AS variance FROM train"
            for c in FEATURES
        )
        + "))",
    ),
    "category_values": q(
        " UNION ALL ".join(
            f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM train" for c in ("code", "sub_code", "sub_category")
        )
    ),
    "horizon_mean_baseline": q(
        f"SELECT horizon, {skill()}, count(*) AS rows FROM val GROUP BY GROUPING SETS ((horizon), ())",
        "cut AS (SELECT ts_index AS start FROM (SELECT ts_index, row_number() OVER (ORDER BY ts_index) - 1 AS pos, "
        "count(*) OVER () AS n FROM (SELECT DISTINCT ts_index FROM train)) "
        "WHERE pos = greatest(1, least(floor((1 - 0.15) * n), n - 1))), "
        "means AS (SELECT horizon, avg(y_target) AS m FROM train WHERE ts_index < (SELECT start FROM cut) GROUP BY horizon), "
        "val AS (SELECT t.*, coalesce(m, 0.0) AS prediction FROM train t LEFT JOIN means USING (horizon) "
        "WHERE ts_index >= (SELECT start FROM cut))",
    ),
    "skill_overall": q(f"SELECT {skill()}, count(*) AS rows FROM scored", SCORED),
    "skill_by_horizon": q(
        f"SELECT horizon, {skill()}, count(*) AS rows FROM scored GROUP BY GROUPING SETS ((horizon), ())", SCORED
    ),
    "skill_by_fold": q(
        f"SELECT horizon, fold, {skill('(y_target * 0.5 + feature_am / 10000 - feature_s)')}, count(*) AS rows "
        "FROM members WHERE role = 'val' GROUP BY horizon, fold",
        FOLDS,
    ),
    "target_encoding": q(
        f"SELECT horizon, 'sub_category' AS level, sub_category AS category, {r('m', 'target_mean')} FROM enc_cat "
        f"UNION ALL SELECT horizon, 'sub_code', sub_code, {r('m', 'target_mean')} FROM enc_code "
        f"UNION ALL SELECT horizon, 'all', NULL, {r('m', 'target_mean')} FROM enc_all",
        ENCODED,
    ),
    "encoded_rows": q(
        f"SELECT x.id, {r('coalesce(c.m, a.m)', 'sub_category_enc')}, {r('coalesce(s.m, a.m)', 'sub_code_enc')} "
        "FROM panel x JOIN enc_all a USING (horizon) LEFT JOIN enc_cat c USING (horizon, sub_category) "
        "LEFT JOIN enc_code s USING (horizon, sub_code)",
        ENCODED,
    ),
    "lag_block": q(
        "SELECT id, " + ", ".join(r(lag(c, k), f"{c}_lag{k}") for c in PAIR for k in (1, 2, 3, 5, 10, 20, 40)) + " FROM panel"
    ),
    "momentum_block": q(
        "SELECT id, "
        + ", ".join(
            r(f"{lag(c, 1)} - {lag(c, 5)}", f"{c}_mom_lag1_minus_lag5")
            + ", "
            + r(f"{lag(c, 1)} / (abs({lag(c, 5)}) + 1e-4)", f"{c}_mom_lag1_div_lag5")
            for c in PAIR
        )
        + " FROM panel"
    ),
    "rolling_block": q(
        "SELECT id, "
        + ", ".join(
            r(frame(f, c, f"{n} PRECEDING", "1 PRECEDING"), f"{c}_{tag}{n}")
            for c in PAIR
            for n in (5, 10, 20)
            for f, tag in (("avg", "rmean"), ("stddev_samp", "rstd"))
        )
        + " FROM panel"
    ),
    "ewm_block": q(
        f"SELECT id, "
        + ", ".join(
            r(
                f"lag(CASE WHEN {c} IS NOT NULL THEN y_{c}_{s} END) OVER (PARTITION BY {SERIES} ORDER BY rn)",
                f"{c}_ewm{s}",
            )
            for c in PAIR
            for s in (5, 10, 20)
        )
        + " FROM walk",
        ewm_cte((5, 10, 20), PAIR),
    ),
    "stationarity_block": q(
        "SELECT id, "
        + ", ".join(
            ", ".join(
                (
                    r(f"{c} - {lag(c, 1)}", f"{c}_diff1"),
                    r(f"{lag(c, 1)} - {lag(c, 2)}", f"{c}_diff_prev"),
                    r(f"({c} - {lag(c, 1)}) / (abs({lag(c, 1)}) + 1e-4)", f"{c}_ret1"),
                )
            )
            for c in PAIR
        )
        + " FROM panel"
    ),
    "hierarchy_block": q(
        "SELECT id, "
        + ", ".join(
            r(f"{c} - {_level(c, key)}", f"{c}_rel_{level}_diff")
            + ", "
            + r(f"{c} / (abs({_level(c, key)}) + 1e-4)", f"{c}_rel_{level}_ratio")
            for c in PAIR
            for level, key in LEVELS
        )
        + " FROM panel"
    ),
    "cross_section_block": q(
        "SELECT id, "
        + ", ".join(
            r(_z(c, "coalesce({std}, 0) + 1e-4"), f"{c}_ts_z") + ", " + r(_ranks(c), f"{c}_ts_rank") for c in PAIR
        )
        + " FROM panel"
    ),
    "missing_indicators": q(
        "SELECT id, CAST(feature_cg IS NULL AS INTEGER) AS feature_cg_isna, "
        "CAST(feature_al IS NULL AS INTEGER) AS feature_al_isna FROM panel"
    ),
    "temporal_impute": q(
        f"SELECT id, {r('coalesce(f, first_value(f IGNORE NULLS) OVER ' + W + ' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'feature_cg')} "
        f"FROM (SELECT *, last_value(feature_cg IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f "
        "FROM panel)"
    ),
    "context_lags": q(
        "SELECT id, "
        + ", ".join(r(lag(c, k), f"{c}_lag{k}") for c in FEATURES for k in (1, 3, 5, 10, 25))
        + ", "
        + ", ".join(r(f"{c} - {lag(c, 1)}", f"{c}_diff1") for c in FEATURES)
        + " FROM panel"
    ),
    "rolling_current_block": q(
        "SELECT id, "
        + ", ".join(
            r(frame(f, c, f"{n - 1} PRECEDING", "CURRENT ROW"), f"{c}_{tag}{n}")
            for c in FEATURES
            for n in (5, 10)
            for f, tag in (("avg", "roll"), ("stddev_samp", "rollstd"))
        )
        + " FROM panel"
    ),
    "ewm_current_block": q(
        "SELECT id, " + ", ".join(r(f"y_{c}_5", f"{c}_ewm5") for c in FEATURES) + " FROM walk", ewm_cte((5,), FEATURES)
    ),
    "cs_z_two_level": q(
        "SELECT id, " + ", ".join(r(_z(c, "nullif({std}, 0) + 1e-6"), f"{c}_cs_z") for c in FEATURES) + " FROM panel"
    ),
    "cycle_features": q(
        f"SELECT id, {r('sin(2 * pi() * ts_index / 100)', 't_cycle_sin')}, "
        f"{r('cos(2 * pi() * ts_index / 100)', 't_cycle_cos')} FROM panel"
    ),
    "interaction_features": q(
        f"SELECT id, {r('feature_al - feature_am', 'd_al_am')}, "
        f"{r('feature_al / (abs(feature_am) + 1e-7)', 'r_al_am')}, {r('feature_cg - feature_by', 'd_cg_by')} FROM panel"
    ),
    "median_stats": q(
        f"SELECT level, sub_category, \"column\", {r('value', 'value')} FROM medians WHERE value IS NOT NULL",
        f"medians AS ({_median_rows(FEATURES, 'train')})",
    ),
    "matrix_fit": _filled("train"),
    "matrix_transform": _filled("test", absent=("feature_s",)),
    "baseline_matrix": q(
        "SELECT x.id, "
        + ", ".join(r(f"coalesce(x.{c}, a.{c}, 0)", c) for c in (*FEATURES, "ts_index"))
        + ", x.code, x.sub_code, x.sub_category, CAST(x.horizon AS VARCHAR) AS horizon FROM test x CROSS JOIN overall a",
        "overall AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in (*FEATURES, "ts_index")) + " FROM train)",
    ),
    "level2_frame": q(
        f"SELECT id, {rs('pred_lgb', 'pred_xgb')}, {r('(pred_lgb + pred_xgb) / 2', 'pred_mean')}, "
        f"{r('pred_lgb - pred_xgb', 'pred_diff')}, {r('abs(pred_lgb - pred_xgb)', 'pred_abs_diff')}, "
        f"{r('least(pred_lgb, pred_xgb)', 'pred_min')}, {r('greatest(pred_lgb, pred_xgb)', 'pred_max')}, "
        f"{rs('ts_index', 'sub_category_enc', 'sub_code_enc')}, {r('sin(2 * pi() * ts_index / 100)', 't_cycle_sin')}, "
        f"{r('cos(2 * pi() * ts_index / 100)', 't_cycle_cos')} FROM two",
        TWO,
    ),
    "candidate_scores": q(
        f"SELECT horizon, candidate, CAST(position AS INTEGER) AS position, {rs('skill')} FROM scores", CANDIDATES
    ),
    "select_candidate": q(f"SELECT horizon, candidate, {rs('skill')} FROM best", CANDIDATES),
    "selected_predictions": q(
        f"SELECT id, horizon, candidate, {rs('prediction')} FROM long JOIN best USING (horizon, candidate)", CANDIDATES
    ),
    "ensemble_mean": q(
        f"SELECT id, {r('(pred_lgb + pred_xgb + pred_meta_ridge) / 3', 'prediction')} FROM cand", CANDIDATES
    ),
    "best_rounds": q(
        "SELECT horizon, tag, CAST(floor(median(best_iteration)) AS INTEGER) AS rounds FROM rounds GROUP BY horizon, tag",
        FOLDS + ", sizes AS (SELECT horizon, fold, count(*) AS n FROM members WHERE role = 'val' GROUP BY horizon, fold), "
        "rounds AS (SELECT horizon, fold, unnest(['regression_s42', 'huber_s42']) AS tag, n % 97 + fold * 3 AS best_iteration FROM sizes)",
    ),
    "choose_rounds": q(
        "SELECT greatest(50, CAST(floor(median(best_iteration)) AS INTEGER)) AS rounds FROM rounds",
        FOLDS + ", sizes AS (SELECT horizon, fold, count(*) AS n FROM members WHERE role = 'val' GROUP BY horizon, fold), "
        "rounds AS (SELECT horizon, fold, unnest(['regression_s42', 'huber_s42']) AS tag, n % 97 + fold * 3 AS best_iteration FROM sizes)",
    ),
    "align_predictions": q(f"SELECT id, horizon, ts_index, {r('feature_al - feature_s', 'prediction')} FROM test"),
    "ridge_single": q(
        f"SELECT id, {r('my + b * (x - mx)', 'prediction')} FROM z JOIN fits USING (horizon)",
        TWO + """,
scaled AS (SELECT horizon, avg(pred_lgb) AS mu, stddev_pop(pred_lgb) AS sd FROM two GROUP BY horizon),
z AS (SELECT id, horizon, weight AS w, y_target AS y, (pred_lgb - mu) / sd AS x FROM two JOIN scaled USING (horizon)),
centre AS (SELECT horizon, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM z GROUP BY horizon),
fits AS (SELECT horizon, any_value(mx) AS mx, any_value(my) AS my,
                sum(w * (x - mx) * (y - my)) / (sum(w * (x - mx) * (x - mx)) + 2.0) AS b
         FROM z JOIN centre USING (horizon) GROUP BY horizon)
""",
    ),
    "stored_fills": q(
        f"SELECT level, sub_category, \"column\", {r('value', 'value')} FROM medians WHERE value IS NOT NULL",
        f"medians AS ({_median_rows(FEATURES, 'train')})",
    ),
    "prediction_file": q(
        "SELECT count(*) AS rows, count(*) FILTER (feature_al IS NULL) AS null_predictions, "
        "count(*) - count(DISTINCT id) AS repeated_ids FROM test"
    ),
    "unseen_rows": q(
        "SELECT horizon, count(*) AS rows FROM train WHERE id NOT IN (SELECT id FROM drawn) GROUP BY horizon", STRATA
    ),
    "test_only_rows": q(f"SELECT id, horizon, ts_index, {rs('weight')} FROM test"),
    "union_diagonal": q(
        f"SELECT split, horizon, count(*) AS rows, count(y_target) AS targets, {r('avg(feature_al)', 'al_mean')} FROM ("
        "SELECT 'train' AS split, * FROM train UNION ALL BY NAME SELECT 'test' AS split, * FROM test) GROUP BY split, horizon"
    ),
}
