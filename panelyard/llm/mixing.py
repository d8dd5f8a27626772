"""Mixing sources to target weights by Sainte-Lague apportionment.

All words of the corpus are cut into `BLOCKS` equal blocks. Seats (blocks) go to sources by the
highest quotients target / (2k + 1), then in the same way from each source to its shards, which
gives every shard an integer quota. Within a shard the words of its documents lie end to end in a
seeded order; a quota above the shard's size first takes whole laps, and the rest takes the blocks
of the shard with the smallest seeded hashes. DataFrame functions only.

Shards are bounded in words and in documents, so a hot source is many shards. What is ordered in
one task is a shard, the shards of one source, or the table of sources (one row each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.llm.store import stored, table

#: Blocks a mix is made of, whatever the corpus: the resolution of a quota is a millionth of it.
BLOCKS = 1_000_000
#: Bounds of a shard on average.
SHARD_WORDS, SHARD_DOCS, SHARD_BLOCKS = 4_000_000, 20_000, 20_000
#: Weights of the sources in code point order, repeating; targets stop at so many times a source.
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
SEED = 42

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per source with `source_size, n_docs, target`.

    Sources take all words by weight; a target stops at `repeats` times its source and the excess
    is shared again. That is a water level: by rising (stop / weight) the first sources are those
    at their stop, and the rest share what is left in proportion. Null is a source, the last one.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    stop = (F.col("source_size") * repeats).cast("double")
    weighed = per_source.withColumn("weight", weight).withColumn("stop", stop)
    rising = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = weighed.withColumn("level", left / left_weight)
    # The level rises while sources stop; the first that does not stop fixes it for the rest.
    stops = F.col("stop") <= F.col("level") * F.col("weight")
    fixed = F.min(F.when(~stops, F.struct("_at", "level"))).over(everything)["level"]
    return (
        shared.withColumn("_at", F.row_number().over(rising))
        .withColumn("_level", fixed)
        .select(
            "source",
            "source_size",
            "n_docs",
            F.when(stops | F.col("_level").isNull(), F.col("stop"))
            .otherwise(F.col("_level") * F.col("weight"))
            .alias("target"),
        )
    )


def sainte_lague(claims: DataFrame, share: str, seats: Column, within: list[str], order: list[Column]) -> DataFrame:
    """`claims` with `quota`: `seats` dealt among the rows of each `within` by highest quotients.

    The rule gives every claimant about round(share / divisor) seats. A divisor a little too large
    deals too few seats, one a little too small too many; only the quotients between the two are
    listed and ranked, at most about two for each claimant. Equal quotients: first in `order`.
    """
    keys = claims.columns
    group = Window.partitionBy(*within)
    total, n = F.sum(share).over(group), F.count(F.lit(1)).over(group)
    claims = claims.withColumns({"_seats": seats, "_total": total, "_n": n})
    sure_divisor = F.when(F.col("_seats") > F.col("_n") / 2, F.col("_total") / (F.col("_seats") - F.col("_n") / 2))
    most_divisor = F.col("_total") / (F.col("_seats") + F.col("_n") / 2)
    seats_at = lambda divisor: F.floor(F.col(share) / divisor + 0.5)
    claims = claims.withColumns(
        {
            "_sure": F.when(F.col("_total") > 0, F.greatest(F.lit(0), F.coalesce(seats_at(sure_divisor), F.lit(0)) - 1))
            .otherwise(0)
            .cast("long"),
            "_most": F.when(F.col("_total") > 0, seats_at(most_divisor) + 1).otherwise(0).cast("long"),
        }
    ).withColumn("_left", F.col("_seats") - F.sum("_sure").over(group))
    quotients = claims.withColumn(
        "_k", F.explode_outer(F.when((F.col(share) > 0) & (F.col("_most") > F.col("_sure")), F.sequence(F.col("_sure"), F.col("_most") - 1)))
    ).withColumn("_quotient", F.col(share) / (2 * F.col("_k") + 1))
    place = F.row_number().over(group.orderBy(F.col("_quotient").desc_nulls_last(), *order))
    won = F.when(F.col("_quotient").isNotNull() & (place <= F.col("_left")), 1).otherwise(0)
    return (
        quotients.withColumn("_won", won)
        .groupBy(*keys, "_sure")
        .agg(F.sum("_won").alias("_more"))
        .select(*keys, (F.col("_sure") + F.col("_more")).alias("quota"))
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    blocks: int = BLOCKS,
    repeats: int = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `docs`: `doc_id, source, size, source_size, target, taken, ranges`.

    `ranges` lists the word ranges (start, end exclusive) that are taken once more than `taken //
    size` whole times. A null text has no words; a null source is a source. Documents without words
    take nothing. Rows that agree in id, source and size are interchangeable. The seed and the ids
    decide, not the partitioning: reruns agree. An empty table gives an empty result.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return _mixed(sizes, weights, blocks, repeats, seed).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "ranges"
    )


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _mixed(sizes: DataFrame, weights, blocks, repeats, seed) -> DataFrame:
    sources = stored(source_targets(sizes, weights, repeats), "targets").withColumnRenamed("source", "_source")
    all_words = F.sum("source_size").over(Window.partitionBy())
    block = F.greatest(F.lit(1), F.ceil(all_words / blocks)).cast("long")
    sources = sources.withColumns(
        {
            "block": block,
            "n_shards": F.greatest(
                F.lit(1),
                F.ceil(F.col("source_size") / SHARD_WORDS),
                F.ceil(F.col("n_docs") / SHARD_DOCS),
                F.ceil(F.col("source_size") / block / SHARD_BLOCKS),
            ).cast("long"),
            "_one": F.lit(1),
        }
    )
    # Whole blocks of all words that sources can hold; with every source at its stop, fewer.
    seats = F.round(F.sum("target").over(Window.partitionBy()) / F.col("block")).cast("long")
    sources = stored(
        sainte_lague(sources, "target", seats, ["_one"], [F.col("_source").asc_nulls_last()])
        .withColumnRenamed("quota", "source_quota")
        .drop("_one"),
        "source_quotas",
    )
    placed = (
        sizes.join(sources, _same_source("source", "_source"))
        .drop("_source")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_shards")))
    )
    shards = placed.groupBy("source", "shard", "source_quota", "block").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(shards, "shard_size", F.col("source_quota"), ["source"], [F.col("shard")])
    shards = stored(
        shards.select(
            F.col("source").alias("_source"),
            F.col("shard").alias("_shard"),
            "shard_size",
            F.least(F.col("quota") * F.col("block"), F.col("shard_size") * repeats).alias("words"),
        ).withColumns(
            {
                "laps": F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long"),
            }
        ).withColumn("rest", F.col("words") - F.col("laps") * F.col("shard_size")),
        "shard_quotas",
    )
    placed = placed.join(
        shards, _same_source("source", "_source") & (F.col("shard") == F.col("_shard"))
    ).drop("_source", "_shard")
    seeded = Window.partitionBy("source", "shard").orderBy(
        F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("doc_id"), F.col("size")
    )
    placed = placed.withColumns(
        {
            "start": F.sum("size").over(seeded.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
            "_row": F.row_number().over(seeded),
        }
    )
    placed = stored(placed, "placed")
    chosen = _chosen_blocks(shards, placed, seed)
    parts = (
        placed.where((F.col("size") > 0) & (F.col("rest") > 0))
        .select("source", "shard", "_row", "start", "size", "block", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))).alias("b"))
        .join(chosen.hint("merge"), _same_source("source", "_source") & (F.col("shard") == F.col("_shard")) & (F.col("b") == F.col("_b")))
        .select(
            "source", "shard", "_row",
            (F.greatest(F.col("b") * F.col("block"), F.col("start")) - F.col("start")).alias("from"),
            (F.least(F.col("b") * F.col("block") + F.col("length"), F.col("start") + F.col("size")) - F.col("start")).alias("to"),
        )
        .where(F.col("from") < F.col("to"))
        .groupBy(F.col("source").alias("_source"), F.col("shard").alias("_shard"), F.col("_row").alias("_r"))
        .agg(
            F.sum(F.col("to") - F.col("from")).alias("part"),
            F.sort_array(F.collect_list(F.struct("from", "to"))).alias("ranges"),
        )
    )
    # Blocks and parts come from small tables and are not small: no estimate is to broadcast them.
    return placed.join(
        parts.hint("merge"),
        _same_source("source", "_source") & (F.col("shard") == F.col("_shard")) & (F.col("_row") == F.col("_r")),
        "left",
    ).withColumn("taken", F.col("laps") * F.col("size") + F.coalesce(F.col("part"), F.lit(0)))


def _chosen_blocks(shards: DataFrame, placed: DataFrame, seed: int) -> DataFrame:
    """The blocks that fill each shard's rest: smallest seeded hash first, the last one cut."""
    block = placed.select(F.col("source").alias("_s"), "block").distinct()
    blocks = (
        shards.where(F.col("rest") > 0)
        .join(block, _same_source("_source", "_s"))
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shard_size") - 1) / F.col("block")))))
        .withColumn("full", F.least(F.col("block"), F.col("shard_size") - F.col("_b") * F.col("block")))
    )
    seeded = Window.partitionBy("_source", "_shard").orderBy(
        F.xxhash64(F.lit(seed + 2), "_source", "_shard", "_b"), "_b"
    )
    so_far = F.sum("full").over(seeded.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")
    return (
        blocks.withColumn("length", F.least(F.col("full"), F.col("rest") - so_far))
        .where(F.col("length") > 0)
        .select("_source", "_shard", "_b", "length")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of `docs`.

    A document is repeated whole as often as the mix takes it whole; the words that are taken once
    more make one further row, whose text is those words with the white space before them.
    """
    columns = docs.columns
    mixed = mix(docs).select(
        F.col("doc_id").alias("_id"),
        F.col("size").alias("_size"),
        F.col("source").alias("_source"),
        "taken",
        "ranges",
    )
    mixed = mixed.where("taken > 0").dropDuplicates(["_id", "_source", "_size"])
    both = docs.withColumn("_words", word_count(F.col("text"))).join(
        mixed.hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & _same_source("source", "_source") & (F.col("_words") == F.col("_size")),
    )
    laps = F.floor((F.col("taken") - _part(F.col("ranges"))) / F.col("_size"))
    copies = F.concat(
        F.array_repeat(F.lit(False), laps.cast("int")),
        F.when(_part(F.col("ranges")) > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    rows = both.withColumn("_cut", F.explode(copies))
    # Used twice, so that the list of words is made once for a row and not for every range.
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    rows = rows.withColumn("_list", F.when(F.col("_cut"), words))
    chosen = F.transform(
        F.col("ranges"), lambda r: F.slice("_list", (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int"))
    )
    some = F.when(F.size("_list") > 0, F.array_join(F.flatten(chosen), ""))
    rows = rows.withColumn("text", F.when(F.col("_cut"), some).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(columns)


def _part(ranges: Column) -> Column:
    return F.coalesce(F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"]), F.lit(0))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
