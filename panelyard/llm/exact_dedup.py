"""Exact dedup through a persistent digest index.

The index is a bucketed table, sorted by digest within each bucket. A batch is reduced to one
row per digest before it is shuffled (map-side combine: a digest of a third of all rows is one
row per task), anti-joined with the index bucket by bucket, and what is new is appended. Only
digests and ids move; texts never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.store import new_path, stored, table

INDEX_SCHEMA = "digest binary, keep_id bigint, group_size bigint"
#: Buckets of an index; its files are rewritten never, so size it for the corpus to come.
BUCKETS = 64


def text_digest(text: Column) -> Column:
    """SHA-256 of the whole text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far.

    `path` outlives the session: opening the same path again attaches to its files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + "".join(c if c.isalnum() else "_" for c in path)[-80:]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def is_empty(self) -> bool:
        return self.read().isEmpty()

    def append_new(self, batch: DataFrame) -> None:
        """Add the digests of `batch` (`digest`, `doc_id`) that the index lacks.

        Of equal texts in the batch the largest id stays (a null id only if there is no other);
        a digest that the index has keeps the id and the size it was stored with. One bucket is
        one task, so the files of an append are as many as the buckets.
        """
        groups = batch.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        if not self.is_empty():
            groups = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        (
            groups.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )


def exact_dedup(
    docs: DataFrame,
    index: DigestIndex | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """`docs` with `keep_id, group_size, kept, text_sha256`: one row per row of `docs`.

    Texts are equal when their bytes are; null equals empty. The row with the largest id of its
    text is kept. Repeated rows with that id count in `group_size` and are all marked kept: they
    cannot be told apart. Ids may be null: such a row stays only if no row of its text has an id.
    An empty table gives an empty result. Columns of `docs` with the names of the result are
    replaced. With an `index` from earlier batches, texts that it holds are kept nowhere in this
    batch: `keep_id` is then the stored id.
    """
    spark = docs.sparkSession
    fresh = DigestIndex(spark, new_path(spark, "digests")) if index is None else index
    known_before = None if index is None or index.is_empty() else index.read().select("digest")
    if known_before is not None:
        known_before = stored(known_before, "known").withColumn("_known", F.lit(True))
    with_digest = docs.withColumn("_digest", text_digest(F.col(text)))
    fresh.append_new(with_digest.select(F.col("_digest").alias("digest"), F.col(doc_id).alias("doc_id")))
    # Read by path, not as a bucketed table: with both sides exchanged on the digest, Spark can
    # split the task of a hot text.
    groups = spark.read.schema(INDEX_SCHEMA).parquet(fresh.path)
    groups = groups.select(
        F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size")
    )
    joined = with_digest.join(groups, "_digest")
    kept = F.col(doc_id).eqNullSafe(F.col("_keep"))
    if known_before is not None:
        joined = joined.join(known_before.withColumnRenamed("digest", "_digest"), "_digest", "left")
        kept = kept & F.col("_known").isNull()
    return joined.withColumns(
        {
            "keep_id": F.col("_keep"),
            "group_size": F.col("_size"),
            "kept": kept,
            "text_sha256": F.lower(F.hex("_digest")),
        }
    ).drop("_digest", "_keep", "_size", "_known")


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each text, that with the largest id; the columns of `docs`."""
    marked = exact_dedup(docs).where("kept").dropDuplicates(["text_sha256"])
    return marked.select(docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
