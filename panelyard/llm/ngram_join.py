"""N-gram Jaccard join by a blocked sparse matrix product.

A document is the set of its distinct word n-grams: a row of the sparse incidence matrix A of
documents by n-grams. The overlap of two documents is an entry of A A^T; it is accumulated by
joining incidence rows on the n-gram and counting per pair. Pairs are discarded by bounds that follow
from the two set sizes before anything is counted:

* size: a pair can reach the threshold t only if t * max(|x|, |y|) <= min(|x|, |y|);
* prefix: under one global order of n-grams, two sets with J >= t share one of the first
  |x| - ceil(t |x|) + 1 n-grams of each, so only those prefix entries are multiplied to find
  candidates;
* position: n-grams that both sets hold up to their last shared prefix n-gram are all in both
  prefixes, and those up to the end of the prefix that ends first are too. So the overlap is at most
  the shared prefix entries plus what follows these places in either set. Before they are counted,
  they are bounded by the entries of each prefix that other classes have too. Pairs that meet in one
  n-gram by chance fail here, before any whole set is rebuilt;
* overlap: J >= t holds iff (1 + t) * overlap >= t * (|x| + |y|), counted on the whole sets of the
  pairs that are left.

Any fixed order keeps the prefix bound exact; rare n-grams first keeps candidates few. The order is
(count of the n-gram's hash bucket, hash), the counts taken over all documents in `FREQ_BUCKETS`
buckets, so the table of counts has a size fixed by the setting. N-grams are hashed inside the
partitions, and only prefixes leave them; of these, only n-grams of two classes or more are kept. The
whole set of a document is rebuilt from its text only if it is in a pair that the bounds leave.

Documents with equal sets are one row of A (their class); its members link with each other. The
product runs in two rounds. First each n-gram's prefix posting list is paired with its smallest
class and with the one that has the fewest n-grams before it (stars: twice as many pairs as entries). A star sees only some of a pair's shared n-grams, so
its bound may drop a pair that the second round then finds. Then every pair that shares a prefix n-gram and is
not yet in one component is multiplied, in blocks: the posting list of an n-gram with many classes
is cut into blocks of `BLOCK`, and each pair of blocks is its own join key, so a hot n-gram spreads
over many tasks. Pairs inside one component change no component and are left out by the join's
condition, so a large group of near copies that the star joined gives no rows. Links found in the
two rounds give the components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.llm.components import components
from panelyard.llm.store import arrow_map, stored, table

#: Words of a shingle; a link needs 100 * overlap >= THRESHOLD_PCT * union.
SHINGLE, THRESHOLD_PCT = 4, 85
#: Classes of one n-gram's prefix postings in one block of the blocked product.
BLOCK = 2048
#: Hash buckets whose counts order the n-grams (a power of two).
FREQ_BUCKETS = 1 << 20
#: Parts in which the table of counts is added up.
FREQ_SLOTS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words split at ASCII
    white space, `shingle` words joined by one space; fewer words give the whole sequence as one;
    none give no hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.sort(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams)), ">u8").astype(np.uint64))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _digests(h: np.ndarray) -> tuple[int, int]:
    """Two order-free digests of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(h).view(np.int64)) if len(h) else 0, int(np.sum(h * _MIX, dtype=np.uint64).view(np.int64)) if len(h) else 0


def _bucket_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """Number of documents' n-grams in each hash bucket, over all documents.

    Every task sends its counts once, packed, in `FREQ_SLOTS` parts; each part is added up in a task.
    """
    buckets, slots = FREQ_BUCKETS, FREQ_SLOTS
    mask = np.uint64(buckets - 1)

    def packed(acc: np.ndarray, found: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array([zlib.compress(part.tobytes(), 1) for part in acc], pa.binary())],
            names=["slot", "counts"],
        )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(buckets, np.int64)
        held, size = [], 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                held.append(shingle_hashes(t, shingle) & mask)
                size += len(held[-1])
                if size >= buckets:
                    acc += np.bincount(np.concatenate(held).astype(np.int64), minlength=buckets)
                    held, size = [], 0
        if held:
            acc += np.bincount(np.concatenate(held).astype(np.int64), minlength=buckets)
        yield packed(acc.reshape(slots, -1), list(range(slots)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, part in zip(batch.column("slot").to_pylist(), batch.column("counts").to_pylist()):
                n = np.frombuffer(zlib.decompress(part), np.int64)
                sums[slot] = sums[slot] + n if slot in sums else n
        yield packed(np.array([sums[k] for k in sums]), list(sums))

    schema = "slot int, counts binary"
    parts = arrow_map(docs.select("text"), counted, schema).repartition(slots, "slot")
    counts = np.zeros((slots, buckets // slots), np.int64)
    for row in arrow_map(parts, added, schema).collect():
        counts[row["slot"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return counts.reshape(-1)


def _signatures(docs: DataFrame, counts: np.ndarray, shingle: int, threshold_pct: int) -> DataFrame:
    """`doc_id, n, d1, d2, prefix` for every row: set size, digests and prefix n-grams."""
    mask = np.uint64(FREQ_BUCKETS - 1)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, prefix = [], [], [], []
            for t in batch.column("text").to_pylist():
                h = shingle_hashes(t, shingle)
                keep = len(h) - (threshold_pct * len(h) + 99) // 100 + 1 if len(h) else 0
                order = np.lexsort((h.view(np.int64), counts[(h & mask).astype(np.int64)]))
                a, b = _digests(h)
                n.append(len(h))
                d1.append(a)
                d2.append(b)
                prefix.append(h[order[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["doc_id", "n", "d1", "d2", "prefix"],
            )

    return arrow_map(docs.select("doc_id", "text"), signed, "doc_id long, n long, d1 long, d2 long, prefix array<long>")


def _full_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """`cls, hashes`: the whole sets of the given texts (`cls, n, d1, d2, text`). Of the rows with the
    id `cls`, those whose set has the size and the digests of the class."""

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, hashes = [], []
            wanted = zip(*(batch.column(c).to_pylist() for c in ("cls", "n", "d1", "d2", "text")))
            for c, n, d1, d2, t in wanted:
                h = shingle_hashes(t, shingle)
                if (len(h), *_digests(h)) == (n, d1, d2):
                    cls.append(c)
                    hashes.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["cls", "hashes"]
            )

    return arrow_map(texts.select("cls", "n", "d1", "d2", "text"), rebuilt, "cls long, hashes array<long>")


def _reaches(overlap: Column, na: Column, nb: Column, threshold_pct: int) -> Column:
    # overlap / (na + nb - overlap) >= t / 100  <=>  (100 + t) * overlap >= t * (na + nb)
    return (100 + threshold_pct) * overlap >= threshold_pct * (na + nb)


def _links_from_overlaps(pairs: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """The sparse product for candidate `pairs` (a, b, na, nb): overlap of each pair's whole sets; the
    pairs that reach the threshold. The hashes of b move first, as one a may be in many pairs."""
    overlap = (
        pairs.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb")), "b")
        .join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha")), "a")
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("ov"))
    )
    return overlap.where(_reaches(F.col("ov"), F.col("na"), F.col("nb"), threshold_pct)).select("a", "b")


def _candidates(met: DataFrame, threshold_pct: int) -> DataFrame:
    """`a, b, na, nb` of the pairs that the size and position bounds leave, from the n-grams at which
    they met. A row of `met` is one n-gram in two prefixes: the classes `x`, `y`, their sizes `n`, its
    place `i` in each prefix, its place `k` among the `s` entries that more classes than one have."""
    nx, ix, kx, sx, ny, iy, ky, sy = (F.col(c) for c in ("nx", "ix", "kx", "sx", "ny", "iy", "ky", "sy"))
    # Behind the prefix of a set of n there are ceil(t * n) - 1 n-grams.
    past = F.floor((threshold_pct * F.greatest(nx, ny) + 99) / 100) - 1
    behind = F.least(nx - ix, ny - iy) - 1
    most = F.least(kx, ky) + 1 + F.least(behind, F.least(sx - kx, sy - ky) - 1 + past)
    pairs = (
        met.where(_size_bound(nx, ny, threshold_pct) & _reaches(most, nx, ny, threshold_pct))
        .groupBy(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
            F.least(nx, ny).alias("na"), F.greatest(nx, ny).alias("nb"),
        )
        .agg(F.count(F.lit(1)).alias("met"), F.min(F.least(behind, past)).alias("rest"))
    )
    return pairs.where(_reaches(F.col("met") + F.col("rest"), F.col("na"), F.col("nb"), threshold_pct)).select("a", "b", "na", "nb")


def _entry(side: str, of: str = "") -> list[Column]:
    """The columns of one prefix entry, named for a side of a pair."""
    return [F.col(f"{of}{c}").alias(side if c == "cls" else f"{c}{side}") for c in ("cls", "n", "i", "k", "s")]


def _size_bound(na: Column, nb: Column, threshold_pct: int) -> Column:
    return 100 * F.least(na, nb) >= threshold_pct * F.greatest(na, nb)


def ngram_join(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold_pct: int = THRESHOLD_PCT
) -> DataFrame:
    """`doc_id, n_shingles, component_id` for every row of `docs`.

    Two documents link when 100 * |x n y| >= `threshold_pct` * |x u y| of their distinct shingle
    sets; `component_id` is the smallest id reachable by links, the document's own included. A null
    or wordless text has an empty set, links with nothing and is its own component; equal non-empty
    sets always link. Texts are read whole. Repeated rows are one document. Rows that share an id
    but not the text are read as the one whose set has the least (size, digests); all of them get
    its component, each its own `n_shingles`. Rows with a null id get `component_id` null. Other
    columns of `docs` are not read, so names that clash with the result do no harm. An empty table
    gives no rows. N-grams are keyed by a 64-bit hash of their text.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = _bucket_counts(rows, shingle)
    sig = stored(_signatures(rows, counts, shingle, threshold_pct), "ngram_signatures")
    known = sig.where(F.col("doc_id").isNotNull())
    chosen = known.where("n > 0").groupBy("doc_id").agg(F.min(F.struct("n", "d1", "d2")).alias("s")).select("doc_id", "s.*")
    classes = chosen.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("cls"))
    member = stored(chosen.join(classes, ["n", "d1", "d2"]).select("doc_id", "cls", "n", "d1", "d2"), "ngram_classes")
    reps = member.where("doc_id = cls").select("cls", "n", "d1", "d2")
    prefix = (
        known.join(reps.withColumnRenamed("cls", "doc_id"), ["doc_id", "n", "d1", "d2"])
        .dropDuplicates(["doc_id"])
        .select(F.col("doc_id").alias("cls"), "n", F.posexplode("prefix").alias("i", "h"))
    )
    # Most n-grams are in one class only: they go before anything else is done with them.
    shared = stored(prefix.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "ngram_shared")
    of_class = Window.partitionBy("cls")
    posting = stored(
        prefix.join(shared, "h").select(
            "h", "m", "cls", "n", "i",
            (F.row_number().over(of_class.orderBy("i")) - 1).alias("k"),
            F.count(F.lit(1)).over(of_class).alias("s"),
        ),
        "ngram_postings",
    )

    def whole_sets(classes: DataFrame, name: str) -> DataFrame:
        wanted = stored(classes.join(reps, "cls"), f"{name}_wanted").withColumnRenamed("cls", "doc_id")
        texts = rows.join(wanted, "doc_id").withColumnRenamed("doc_id", "cls")
        return stored(_full_sets(texts, shingle).dropDuplicates(["cls"]), name)

    def members(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()

    # Round 1: every prefix entry against two classes of its n-gram, the smallest one and the one with
    # the fewest n-grams before it, which in a group of near copies is the one with the fewest changes.
    pivots = posting.groupBy("h").agg(
        F.min(F.struct("cls", "n", "i", "k", "s")).alias("p"), F.min(F.struct("i", "cls", "n", "k", "s")).alias("q")
    )
    q = F.struct(*[F.col(f"q.{c}") for c in ("cls", "n", "i", "k", "s")])
    pivots = pivots.select("h", F.explode(F.array_distinct(F.array("p", q))).alias("p"))
    star = stored(
        _candidates(
            posting.join(pivots, "h").where(F.col("cls") != F.col("p.cls")).select(*_entry("x", "p."), *_entry("y")),
            threshold_pct,
        ),
        "ngram_star",
    )
    full = whole_sets(members(star), "ngram_sets")
    first = stored(_links_from_overlaps(star, full, threshold_pct), "ngram_links")
    comp = stored(components(first, "ngram_stars"), "ngram_components")

    # Round 2: all pairs of a prefix posting list that are in different components, in blocks.
    posted = (
        posting.join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left")
        .withColumn("component", F.coalesce("component", "cls"))
        .withColumn("nb_blocks", F.ceil(F.col("m") / BLOCK))
        .withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nb_blocks")))
    )
    posted = stored(posted, "ngram_posted")
    lo = posted.select(
        "h", F.col("blk").alias("bx"), F.explode(F.sequence("blk", F.col("nb_blocks") - 1)).alias("by"),
        *_entry("x"), F.col("component").alias("cx"),
    )
    hi = posted.select(
        "h", F.explode(F.sequence(F.lit(0).cast("long"), "blk")).alias("bx"), F.col("blk").alias("by"),
        *_entry("y"), F.col("component").alias("cy"),
    )
    met = lo.join(hi, ["h", "bx", "by"]).where(
        ((F.col("bx") != F.col("by")) | (F.col("x") < F.col("y"))) & (F.col("cx") != F.col("cy"))
    )
    cross = stored(_candidates(met, threshold_pct), "ngram_cross")
    rest = members(cross).join(full.select("cls"), "cls", "left_anti")
    full = full.unionByName(whole_sets(rest, "ngram_more_sets"))
    second = stored(_links_from_overlaps(cross, full, threshold_pct), "ngram_links")
    final = components(first.unionByName(second), "ngram_final")
    of_id = member.join(final.select(F.col("node").alias("cls"), "component"), "cls", "left").select(
        "doc_id", F.coalesce("component", "cls").alias("component_id")
    )
    out = sig.join(of_id, "doc_id", "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
        .otherwise(F.coalesce("component_id", F.col("doc_id")))
        .alias("component_id"),
    )


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
