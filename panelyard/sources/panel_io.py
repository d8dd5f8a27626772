"""Readers and writers of panels, predictions and summaries."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.contract import KEY_COLUMNS, SERIES, feature_columns

SERIES_ORDER = (*SERIES, "ts_index")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: NaN is turned into NULL once, at the scan."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floating else F.col(c) for c in df.columns])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_horizon(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    horizon: int,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one horizon: filter and columns reach the parquet scan."""
    train_raw = spark.read.parquet(train_path)
    features = feature_columns(train_raw)
    only = F.col("horizon") == horizon
    train = train_raw.where(only).select("id", *KEY_COLUMNS, "weight", "y_target", *features)
    test = spark.read.parquet(test_path).where(only).select("id", *KEY_COLUMNS, *features)
    return nan_to_null(train), nan_to_null(test)


def cap_tail(df: DataFrame, n: int) -> DataFrame:
    """Last n rows in series order; 0 keeps everything."""
    return df if n <= 0 else df.orderBy(*[F.desc(c) for c in SERIES_ORDER]).limit(n)


def cap_head(df: DataFrame, n: int) -> DataFrame:
    """First n rows in series order; 0 keeps everything."""
    return df if n <= 0 else df.orderBy(*SERIES_ORDER).limit(n)


def parquet_profile(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, rows, columns, mb) per path. Counts rows per file; no column is read."""
    parts = []
    for name, path in paths.items():
        df = spark.read.parquet(path)
        per_file = df.groupBy(F.col("_metadata.file_path").alias("f")).agg(
            F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("bytes")
        )
        parts.append(
            per_file.agg(F.sum("n").alias("rows"), (F.sum("bytes") / (1024 * 1024)).alias("mb")).select(
                F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), "mb"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prediction_mismatches(test: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ids that are only in one of the two tables, or predicted more than once."""
    expected, given = test.select("id"), predictions.select("id")
    lost = expected.join(given, "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    extra = given.join(expected, "id", "left_anti").select("id", F.lit("unknown").alias("problem"))
    twice = given.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("problem"))
    return lost.unionByName(extra).unionByName(twice)


def write_predictions(test: DataFrame, predictions: DataFrame, path: str) -> None:
    """CSV `id,prediction` sorted by id. Every test id must be predicted exactly once."""
    first = prediction_mismatches(test, predictions).first()
    if first is not None:
        raise ValueError(f"predictions do not match the test rows: {first['problem']} id {first['id']}")
    out = predictions.select("id", F.col("prediction").cast("double").alias("prediction"))
    out.orderBy("id").write.mode("overwrite").csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def check_prediction_file(spark: SparkSession, path: str) -> DataFrame:
    """(rows, null_predictions, repeated_ids) of a written prediction file."""
    df = spark.read.schema("id string, prediction double").csv(path, header=True)
    # One row per id: repeats are counted without a second pass.
    per_id = df.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction").isNull()).alias("nulls")
    )
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_predictions"),
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
    )


def write_summary(spark: SparkSession, payload: dict, path: str) -> None:
    """Settings and scores of a run as one JSON record. The payload is small by nature."""
    line = spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)


SUMMARY_SCHEMA = """
    objectives string, seeds array<int>, final_metric double,
    score_by_horizon map<string, double>,
    best_iterations map<string, map<string, int>>,
    feature_config_by_horizon map<string, string>,
    params string
"""


def read_summary(spark: SparkSession, path: str) -> dict:
    """A run summary with typed keys: horizons as int, rounds as int, objectives as a list.

    `objectives` may be a JSON list or a comma-separated text.
    """
    row = spark.read.schema(SUMMARY_SCHEMA).json(path).first()
    text = row["objectives"] or ""
    objectives = json.loads(text) if text.startswith("[") else [t.strip() for t in text.split(",") if t.strip()]
    return {
        "objectives": objectives,
        "seeds": [int(s) for s in row["seeds"] or []],
        "final_metric": row["final_metric"],
        "score_by_horizon": {int(k): v for k, v in (row["score_by_horizon"] or {}).items()},
        "best_iterations": {
            int(h): {tag: int(n) for tag, n in tags.items()} for h, tags in (row["best_iterations"] or {}).items()
        },
        "feature_config_by_horizon": {
            int(h): json.loads(v) for h, v in (row["feature_config_by_horizon"] or {}).items()
        },
        "params": json.loads(row["params"]) if row["params"] else None,
    }


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for reliable intermediate tables.

    On a cluster it must be set (`spark.checkpoint.dir`); a local session that sets none
    gets a temporary one.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    import tempfile

    made = tempfile.mkdtemp(prefix="panelyard-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def run_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one. It is marked to go when the driver's JVM
    ends, through the file system it lies in."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/panelyard-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` once to the run's folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(_stored_schema(df, partition_by)).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a `stored` table that is not read again."""
    context = table.sparkSession.sparkContext
    for file in table.inputFiles():
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, False)


#: Rows up to which a side is broadcast by hint.
SMALL_ROWS = 10_000


def small_side(df: DataFrame, name: str) -> DataFrame:
    """`df` stored and counted; with few rows (one per horizon, say) marked for broadcast, so that
    the other side is not dealt out by a key of few values."""
    kept = stored(df, name)
    return F.broadcast(kept) if kept.count() <= SMALL_ROWS else kept


def _stored_schema(df: DataFrame, partition_by) -> T.StructType:
    """Partition columns keep their declared type instead of an inferred one."""
    fields = [f for f in df.schema.fields if f.name not in partition_by]
    fields += [f for f in df.schema.fields if f.name in partition_by]
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in fields])
