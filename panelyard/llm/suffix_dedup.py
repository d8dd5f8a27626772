"""Removal of repeated 200-byte strings by sorted suffixes.

Sorting all suffixes of a corpus is neither needed nor affordable: only strings that occur twice
matter. So the suffixes are first dealt so that equal ones meet, and few others come along:

1. Anchors. Of the `GRAM`-byte strings inside a window of `LENGTH` bytes the one with the smallest
   hash is the window's anchor. Equal windows have equal anchors at equal places, so every window
   belongs to one anchor, and the windows of an anchor lie side by side: a context.
2. An anchor that occurs once has no repeated window. Contexts of the others with equal digests
   (inside long copies nearly all) are repeated as a whole.
3. What is left, contexts that differ under one anchor (edges of copies, edits), is sorted: shards of
   whole anchors are joined into one text, and its suffix array is built in two stages. Suffixes
   smaller than their successors are sorted directly, the others are induced from them in one scan
   over buckets by first byte. Neighbours in the array with a common prefix of `LENGTH` bytes are
   repeated windows.

An anchor with more contexts than a shard takes is not sorted in one task: its windows are counted
by digest, aggregated before the shuffle, in pieces of `PIECE_WINDOWS` at equal places about the
anchor. The bytes that all windows of a piece hold must occur twice for one of them to; whole pieces
that occur twice are done; only pieces in between are taken window by window. Documents move once,
to a table that later passes read bucket by bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.store import arrow_map, new_path, stored, table

LENGTH, GRAM = 200, 48
#: Bytes hashed at once, and contexts of one anchor that are sorted in a shard.
PIECE, SHARD_CONTEXTS = 250_000, 500
#: Windows of a piece of the contexts of an anchor that has more of them.
PIECE_WINDOWS = 8
#: A byte that no UTF-8 text holds; it ends a context in a shard's text.
END = 0xFF

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    base = np.ones(n + 1, np.uint64)
    base[1:] = _BASE
    inverse = np.ones(n + 1, np.uint64)
    inverse[1:] = np.uint64(pow(int(_BASE), -1, 2**64))
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def _gram_hashes(octets: np.ndarray, gram: int, powers) -> np.ndarray:
    """A mixed hash of each `gram`-byte string of a text, from one running sum."""
    base, inverse = powers
    n = len(octets)
    mixed = (octets.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed * inverse[:n], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * base[: n - gram + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    return hashes


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(octets: np.ndarray, starts: np.ndarray, powers, length: int = LENGTH, gram: int = GRAM):
    """Contexts of texts laid end to end (`starts`: where each begins, and the end of all).

    Returns the anchor hash, the text, the first window, the number of windows and the place of the
    anchor in the first window, of each context.
    Ties go to the leftmost string, so the choice depends on a window's bytes alone.
    """
    none = np.zeros(0, np.int64)
    if len(octets) < length:
        return none.astype(np.uint64), none, none, none, none
    hashes = _gram_hashes(octets, gram, powers)
    bits = np.uint64(max(1, int(len(octets)).bit_length()))
    ranked = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_min(ranked, length - gram + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + length <= starts[text + 1])
    if not len(inside):
        return none.astype(np.uint64), none, none, none, none
    at, text = at[inside], text[inside]
    new = np.flatnonzero((at[1:] != at[:-1]) | (text[1:] != text[:-1])) + 1
    first = np.concatenate([[0], new])
    windows = np.diff(np.concatenate([first, [len(at)]]))
    # Windows of one anchor and text lie side by side: nothing of the text is left out between them.
    return hashes[at[first]], text[first], inside[first], windows, at[first] - inside[first]


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Joined texts of about `PIECE` bytes, with the text and the offset each part comes from.

    Longer texts are cut so that each window is in one part.
    """
    parts: list[bytes] = []
    origin: list[tuple[int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[start : start + PIECE + LENGTH - 1]
            parts.append(part)
            origin.append((i, start))
            size += len(part)
            if size >= PIECE:
                yield b"".join(parts), [*origin, *_ends(parts)]
                parts, origin, size = [], [], 0
    if parts:
        yield b"".join(parts), [*origin, *_ends(parts)]


def _ends(parts: list[bytes]) -> list[tuple[int, int]]:
    return [(-1, len(p)) for p in parts]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`anchor, digest, row, start, windows, place` for the contexts of `row, octets`."""
    powers = None
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            rows = part.column(0).to_numpy(zero_copy_only=False)
            for joined, marks in _pieces([t.as_py() for t in part.column(1)]):
                n = len(marks) // 2
                starts = np.concatenate([[0], np.cumsum([m[1] for m in marks[n:]])])
                if powers is None or len(powers[0]) <= len(joined):
                    powers = _powers(max(len(joined), PIECE * 2))
                anchor, text, first, windows, place = anchors(np.frombuffer(joined, np.uint8), starts, powers)
                digest = np.fromiter(
                    (xxhash.xxh3_64_intdigest(joined[a : a + w + LENGTH - 1]) for a, w in zip(first.tolist(), windows.tolist())),
                    np.uint64,
                    len(first),
                )
                owner = np.array([m[0] for m in marks[:n]], np.int64)
                offset = np.array([m[1] for m in marks[:n]], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        pa.array(rows[owner[text]]),
                        pa.array(first - starts[text] + offset[text]),
                        pa.array(windows.astype(np.int16)),
                        pa.array(place.astype(np.int16)),
                    ],
                    ["anchor", "digest", "row", "start", "windows", "place"],
                )


def suffix_array(text: bytes, depth: int) -> list[int]:
    """Suffixes of `text` in order of their first `depth` bytes, built in two stages.

    A suffix is of type B if it is smaller than its successor (the one a byte later), else of type
    A; the last one is of type A. Type B suffixes are sorted directly, bucket by first byte. One scan
    from left to right then puts each type A suffix at the head of its bucket as its successor, which
    is smaller and so already placed, comes by.
    """
    n = len(text)
    if not n:
        return []
    octets = np.frombuffer(text, np.uint8)
    # A suffix compares to its successor as the byte compares to the next one that differs.
    changes = np.flatnonzero(octets[1:] != octets[:-1])
    is_b = np.zeros(n, bool)
    rising = octets[changes] < octets[changes + 1]
    run_start = np.concatenate([[0], changes + 1])
    for_run = np.concatenate([rising, [False]])
    is_b[:] = np.repeat(for_run, np.diff(np.concatenate([run_start, [n]])))
    size = np.bincount(octets, minlength=256)
    bucket = np.concatenate([[0], np.cumsum(size)])
    order = [-1] * n
    direct = np.flatnonzero(is_b).tolist()
    direct.sort(key=lambda i: text[i : i + depth])
    of_b = np.bincount(octets[is_b], minlength=256)
    # Within a bucket type A comes before type B.
    tail = (bucket[1:] - of_b).tolist()
    for i in direct:
        c = text[i]
        order[tail[c]] = i
        tail[c] += 1
    head = bucket[:-1].tolist()
    type_b = is_b.tolist()
    last = text[n - 1]
    order[head[last]] = n - 1
    head[last] += 1
    for place in range(n):
        i = order[place] - 1
        if i >= 0 and not type_b[i]:
            c = text[i]
            order[head[c]] = i
            head[c] += 1
    return order


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Windows of each context that occur elsewhere in the contexts, as their starts."""
    end = bytes([END])
    text = end.join(contexts) + end
    starts = np.cumsum([0, *(len(c) + 1 for c in contexts)])
    order = np.array(suffix_array(text, length))
    # Only windows that end before their context does; their neighbours in the array are such too.
    owner = np.searchsorted(starts, order, "right") - 1
    whole = order[order + length <= starts[owner + 1] - 1]
    common = np.fromiter(
        (text[a : a + length] == text[b : b + length] for a, b in zip(whole[:-1].tolist(), whole[1:].tolist())),
        bool,
        max(len(whole) - 1, 0),
    )
    repeated = np.zeros(len(whole), bool)
    repeated[:-1] |= common
    repeated[1:] |= common
    found = np.sort(whole[repeated])
    owner = np.searchsorted(starts, found, "right") - 1
    cuts = np.searchsorted(owner, np.arange(1, len(contexts)))
    return [part - starts[i] for i, part in enumerate(np.split(found, cuts))]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, count)."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(r[0]), len(r)) for r in np.split(starts, cuts)]


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`row, start, windows` of repeated windows, from contexts sorted by anchor.

    Whole anchors are gathered until a shard is full; an anchor has at most `SHARD_CONTEXTS`.
    """
    held: list[tuple[int, int, int, bytes]] = []
    limit = SHARD_CONTEXTS

    def emit(rows):
        out = []
        for (_, row, start, _), found in zip(rows, repeated_starts([r[3] for r in rows])):
            out += [(row, start + a, n) for a, n in _runs(found)]  # a context has few windows
        if out:
            row, start, windows = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(windows, pa.int16())],
                ["row", "start", "windows"],
            )

    for batch in batches:
        for item in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if len(held) >= limit and held[-1][0] != item[0]:
                yield from emit(held)
                held = []
            held.append(item)
    if held:
        yield from emit(held)


def _pieces_of_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`core, whole, row, start, octets` for the pieces of contexts (`row, start, place, context`).

    `core` is the digest of what all windows at these places hold, `whole` that of the piece (null
    if the context does not have all its windows).
    """
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            out: list[tuple] = []
            for row, start, place, context in zip(*(part.column(i).to_pylist() for i in range(4))):
                windows = len(context) - LENGTH + 1
                # Place of the context's start on the anchor's grid; LENGTH keeps it positive.
                shift = LENGTH - place
                first = 0
                while first < windows:
                    cell = (first + shift) // PIECE_WINDOWS
                    low = cell * PIECE_WINDOWS - shift
                    end = min(low + PIECE_WINDOWS, windows)
                    core = b"%d " % cell + context[low + PIECE_WINDOWS - 1 : low + LENGTH]
                    full = low == first and end == low + PIECE_WINDOWS
                    octets = context[first : end + LENGTH - 1]
                    out.append(
                        (xxhash.xxh3_128_digest(core), xxhash.xxh3_128_digest(octets) if full else None, row, start + first, octets)
                    )
                    first = end
            core, whole, row, start, octets = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(core, pa.binary()), pa.array(whole, pa.binary()), pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(octets, pa.binary())],
                ["core", "whole", "row", "start", "octets"],
            )


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`window, row, start` for each window of pieces (`row, start, octets`)."""
    for batch in batches:
        out: list[tuple] = []
        for row, start, octets in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for i in range(len(octets) - LENGTH + 1):
                out.append((xxhash.xxh3_128_digest(octets[i : i + LENGTH]), row, start + i))
        window, row, start = zip(*out) if out else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(window, pa.binary()), pa.array(row, pa.int64()), pa.array(start, pa.int64())], ["window", "row", "start"]
        )


def _crowded_windows(contexts: DataFrame) -> DataFrame:
    """`row, start, windows` of repeated windows among the contexts of crowded anchors."""
    pieces = stored(
        arrow_map(
            contexts.select("row", "start", "place", "context"),
            _pieces_of_contexts,
            "core binary, whole binary, row bigint, start bigint, octets binary",
        ),
        "pieces",
    )
    cores = pieces.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    able = stored(pieces.join(stored(cores, "cores"), "core", "left_semi").drop("core"), "able_pieces")
    doubles = stored(
        able.where("whole IS NOT NULL").groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start")).alias("one")).where("n > 1"),
        "double_pieces",
    )
    marked = able.join(doubles, "whole", "left")
    full = marked.where("n > 1").select("row", "start", F.lit(PIECE_WINDOWS).cast("smallint").alias("windows"))
    one = (F.col("one.row") == F.col("row")) & (F.col("one.start") == F.col("start"))
    rest = marked.where(F.col("n").isNull() | one).select("row", "start", "octets")
    windows = stored(arrow_map(rest, _window_digests, "window binary, row bigint, start bigint"), "windows")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    single = windows.join(stored(twice, "double_windows"), "window", "left_semi")
    return full.unionByName(single.select("row", "start", F.lit(1).cast("smallint").alias("windows")))


def repeated_windows(texts: DataFrame) -> DataFrame:
    """`row, start, windows`: runs of windows of `texts` (`row, octets`) that start elsewhere too."""
    found = stored(
        arrow_map(texts, _contexts, "anchor bigint, digest bigint, row bigint, start bigint, windows smallint, place smallint"), "contexts"
    )
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    # Written first: a join of two plain exchanges is one whose hot keys Spark can split.
    shared = stored(found.join(stored(again, "shared_anchors"), "anchor", "left_semi"), "shared_contexts")
    kinds = stored(
        shared.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start", "windows", "place")).alias("one")),
        "context_kinds",
    )
    # Contexts with a double are repeated as a whole.
    doubles = kinds.where("copies > 1").select("anchor", "digest")
    whole = shared.join(doubles, ["anchor", "digest"], "left_semi").select("row", "start", "windows")
    # Of those that differ under one anchor, one of each kind is sorted.
    differing = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    spans = (
        kinds.join(differing, "anchor")
        .select("anchor", "one.*", "kinds")
        .groupBy("row")
        .agg(F.collect_list(F.struct("anchor", "start", "windows", "place", "kinds")).alias("spans"))
    )
    cut = (
        texts.join(spans.hint("shuffle_hash"), "row")
        .select("row", "octets", F.explode("spans").alias("s"))
        .select(
            "s.anchor",
            "row",
            "s.start",
            F.substring("octets", F.col("s.start").cast("int") + 1, F.col("s.windows").cast("int") + (LENGTH - 1)).alias("context"),
            "s.place",
            "s.kinds",
        )
    )
    cut = stored(cut, "differing_contexts")
    in_shards = cut.where(F.col("kinds") <= SHARD_CONTEXTS).select("anchor", "row", "start", "context")
    in_shards = in_shards.repartition("anchor").sortWithinPartitions("anchor")
    from_shards = arrow_map(in_shards, _sorted_shards, "row bigint, start bigint, windows smallint")
    from_crowded = _crowded_windows(cut.where(F.col("kinds") > SHARD_CONTEXTS))
    return whole.unionByName(from_shards).unionByName(from_crowded)


def numbered_texts(docs: DataFrame) -> DataFrame:
    """`row, doc_id, octets` of every row, in a table with a bucket for each shuffle partition.

    Two later joins on `row` then move no text.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "texts")
    name = "texts_" + path[-32:]
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("octets"),
    )
    (
        texts.repartition(buckets, "row")
        .write.format("parquet")
        .option("compression", "zstd")
        .option("path", path)
        .bucketBy(buckets, "row")
        .saveAsTable(name)
    )
    return spark.table(name)


def without_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` (and `kept`, the bytes) for every row.

    A byte goes if a string of `LENGTH` bytes that covers it also starts at another place, in this
    document or another; overlaps count, and all is judged on the input. Null counts as empty.
    Shorter texts keep everything; repeated rows of texts that are long enough lose everything. Ids
    may be null or repeated. Other columns are not read. An empty table gives an empty result.
    """
    texts = numbered_texts(docs)
    runs = repeated_windows(texts.select("row", "octets"))
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    marked = texts.join(runs.hint("shuffle_hash"), "row", "left").select("doc_id", "octets", "runs")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = [_kept(part.column(1)[i].as_py(), part.column(2)[i]) for i in range(part.num_rows)]
                sizes, gone, spans, kept = zip(*rows)
                columns = [part.column(0), pa.array(sizes), pa.array(gone), pa.array(spans)]
                columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_bytes:
                    columns.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names + ["kept"] * keep_bytes)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return arrow_map(marked, removed, schema + ", kept binary" * keep_bytes)


def _kept(octets: bytes, runs: pa.ListScalar) -> tuple[int, int, int, bytes]:
    """Size, bytes and runs removed, and what stays of one text."""
    if not runs.is_valid:
        return len(octets), 0, 0, octets
    start = runs.values.field(0).to_numpy(zero_copy_only=False)
    end = start + runs.values.field(1).to_numpy(zero_copy_only=False) + LENGTH - 1
    depth = np.zeros(len(octets) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    gone = np.cumsum(depth[:-1]) > 0
    edges = np.diff(np.concatenate([[0], gone.view(np.int8)]))
    kept = np.frombuffer(octets, np.uint8)[~gone].tobytes()
    return len(octets), int(gone.sum()), int((edges == 1).sum()), kept


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)
