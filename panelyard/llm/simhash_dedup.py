"""SimHash near-dedup with Golay codes.

Distinct fingerprints are linked at 3 or fewer differing bits, in steps that each spread over keys:

1. Pigeonhole: of four segments of 16 bits, one is equal in linked fingerprints. The other 48 bits
   hold at most 3 errors, so one of their halves holds at most 1.
2. The perfect code (23, 12, 7) decodes 23 bits of a half to a codeword. Words at distance 1 share a
   key if each takes the indices of all codewords within distance 4: one, or six for a word with
   three errors. Segment, half and index make a key of 31 bits; eight tables of keys.
3. Fingerprints with a key in common are compared bit by bit. A key writes only links that join what
   was apart, so a group of many near copies gives as many links as members, not all pairs. Keys of
   many fingerprints are cut into blocks, and each pair of blocks is its own group.

Exact copies share a fingerprint and are one node. Components follow from the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.components import components
from panelyard.llm.store import arrow_map, stored, table

SHINGLE, MOST_BITS, HASH_SEED = 3, 3, 42
#: Fingerprints of a key that are compared in one group; keys with more are cut into blocks.
BLOCK = 4096
#: Generator polynomial of the Golay code (23, 12, 7).
GOLAY = 0xC75


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingle hashes; no words give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        octets = hashes[start : start + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`doc_id, text_hash, fp` (fp as a signed long) for every row of `docs`."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"]
            )

    picked = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(picked, of_batches, f"doc_id {kind}, text_hash bigint, fp bigint")


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the three octets of a word; by syndrome the error of weight 3 or less, and the
    five of weight 4 where that has weight 3 (else zeros)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    octets = np.array([[remainder((value << 8 * i) & 0x7FFFFF) for value in range(256)] for i in range(3)], np.int64)
    near, next_near = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64)
    single = [remainder(1 << i) for i in range(23)]
    for weight in (1, 2, 3, 4):
        filled = np.zeros(2048, np.int64)
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            error = sum(1 << b for b in bits)
            if weight < 4:
                near[syndrome] = error
            else:
                next_near[syndrome, filled[syndrome]] = error
                filled[syndrome] += 1
    return octets, near, next_near


def fuzzy_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): key, place of its fingerprint in `fps`, and whether it is the
    codeword nearest to the fingerprint. One of two linked fingerprints is nearest to a shared key."""
    octets, near, next_near = tables
    keys, owners, nearest = [], [], []
    for segment in range(4):
        shift = np.uint64(16 * segment)
        exact = ((fps >> shift) & np.uint64(0xFFFF)).astype(np.int64)
        below = fps & ((np.uint64(1) << shift) - np.uint64(1))
        above = (fps >> shift >> np.uint64(16)) << shift
        rest = above | below
        for half in range(2):
            word = ((rest >> np.uint64(24 * half)) & np.uint64(0x7FFFFF)).astype(np.int64)
            syndrome = octets[0][word & 255] ^ octets[1][word >> 8 & 255] ^ octets[2][word >> 16]
            base = (segment * 2 + half) << 28 | exact << 12
            keys.append(base | (word ^ near[syndrome]) >> 11)
            owners.append(np.arange(len(fps)))
            nearest.append(np.ones(len(fps), bool))
            far = np.flatnonzero(next_near[syndrome, 0])
            more = (word[far, None] ^ next_near[syndrome[far]]) >> 11
            keys.append((base[far, None] | more).ravel())
            owners.append(np.repeat(far, 5))
            nearest.append(np.zeros(len(far) * 5, bool))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(nearest)


def key_rows(nodes: DataFrame) -> DataFrame:
    """`key, fp, nearest`: some 43 rows for each distinct fingerprint of `nodes` (`fp`)."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(every), 4096):
                fps = every[start : start + 4096]
                key, owner, nearest = fuzzy_keys(fps.view(np.uint64), tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int32)), pa.array(fps[owner]), pa.array(nearest)], ["key", "fp", "nearest"]
                )

    return arrow_map(nodes.select("fp"), of_batches, "key int, fp bigint, nearest boolean")


def links(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """`a, b`: links between distinct fingerprints that connect all that are `most_bits` or fewer
    apart (3 at most: the keys promise no more)."""
    if most_bits > 3:
        raise ValueError("keys of this code find links of 3 differing bits or fewer")
    rows = key_rows(nodes)
    crowded = stored(
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "crowded_keys"
    )
    blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(F.least(other, F.col("own")).alias("low"), F.greatest(other, F.col("own")).alias("high")),
    )
    placed = (
        rows.join(crowded, "key", "left")
        .withColumn("_blocks", blocks)
        .withColumn("own", own)
        .withColumn("cell", F.explode(cells))
        .select("key", "cell.low", "cell.high", "fp", "nearest")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if kept is not None:
                columns = [np.concatenate(pair) for pair in zip(kept, columns)]
            key, low, high = columns[:3]
            new = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            last = int(new[-1]) if len(new) else 0  # the last group may go on
            kept = [c[last:] for c in columns]
            yield from _linked(columns[3][:last], columns[4][:last], np.concatenate([[0], new]), most_bits)
        if kept is not None:
            yield from _linked(kept[3], kept[4], np.array([0, len(kept[3])]), most_bits)

    grouped = placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return arrow_map(grouped, compared, "a bigint, b bigint")


def _linked(fps: np.ndarray, nearest: np.ndarray, starts: np.ndarray, most_bits: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    fps = fps.view(np.uint64)
    sizes = np.diff(starts)
    pairs = starts[:-1][sizes == 2]
    near = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= most_bits if len(pairs) else np.zeros(0, bool)
    out += zip(fps[pairs[near]].view(np.int64).tolist(), fps[pairs[near] + 1].view(np.int64).tolist())
    for group in np.flatnonzero(sizes > 2):
        members = slice(int(starts[group]), int(starts[group + 1]))
        out += _forest(fps[members], nearest[members], most_bits)
    if out:
        a, b = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _forest(fps: np.ndarray, nearest: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Links of one group that join what was apart; fewer than its members."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return int(i)

    out = []
    for i in np.flatnonzero(nearest).tolist():
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= most_bits).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(fps[i : i + 1].view(np.int64)[0]), int(fps[j : j + 1].view(np.int64)[0])))
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """`doc_id, text_hash, fp, component, component_id` for every row of `docs`.

    `component` is the smallest fingerprint of the group, `component_id` its smallest id (null only
    if all ids of the group are). Null and empty texts, and texts of white space, have fingerprint
    0 and are linked like others. Repeated rows are rows of one group. Other columns are not read;
    an empty table gives an empty result.
    """
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    found = components(links(nodes, most_bits), "near_links").withColumnRenamed("node", "fp")
    labelled = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    groups = labelled.select("fp", "component").join(ids, "component")
    return marked.join(groups, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group, with the columns of `docs`: that with the smallest id.

    Among rows with that id, the one whose text hash is smallest; of equal rows any one.
    """
    marked = near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    stays = marked.groupBy("component").agg(F.min(order).alias("row")).select("row._id", "row._hash")
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    kept = hashed.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_hash"]).select(docs.columns)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
