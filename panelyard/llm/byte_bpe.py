"""Byte-level BPE: encoding by a rank queue, decoding, and digests of both.

Merging works on one pre-token at a time. A bucket per merge rank holds positions of a linked list
of tokens; a bitmap in two levels tells the first bucket that is not empty, and find-first-set in
both picks the next rank. Entries that a merge has made wrong stay in their bucket and are skipped
when they come up. A pre-token of n bytes costs about n log n, so one of a whole document is fine.

Texts are independent rows: Spark spreads them, and each Python worker keeps a bounded cache of the
words it has met. The rank file (under a megabyte) is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.store import arrow_map, table

#: Words and pre-tokens a worker remembers at most; others are encoded each time they come.
CACHED_WORDS, CACHED_PIECES = 300_000, 1_000_000
#: Bits of a word of the bitmap, as a shift.
LEVEL = 8

#: A space or line feed before white space or the end: such texts are cut by pattern.
_UNEVEN = re.compile(r"[ \n](?!\S)")
_LINE, _WORD = re.compile(r"\n(?=\S)"), re.compile(r" (?=\S)")


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class RankQueue:
    """Positions by merge rank; the leftmost position of the lowest rank comes first.

    `merged` keeps the queue in local names: it is the inner loop of all encoding. Every bucket is
    empty again when a pre-token is done, so one queue serves a worker for good.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((max(ranks.values(), default=0) >> LEVEL) + 1)
        self.bit = [1 << i for i in range(max(len(self.words), 1 << LEVEL))]

    def merged(self, piece: bytes) -> list[int]:
        """Starts of the tokens of `piece`, and its length."""
        rank_of, buckets, words, bit = self.ranks.get, self.buckets, self.words, self.bit
        low_bits, top, n = (1 << LEVEL) - 1, 0, len(piece)
        following = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        for at, rank in enumerate(pair):
            if rank is None:
                continue
            if rank in buckets:
                buckets[rank].append(at)  # rising positions are a heap
                continue
            buckets[rank] = [at]
            high = rank >> LEVEL
            words[high] |= bit[rank & low_bits]
            top |= bit[high]
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            low = word & -word
            rank = (high << LEVEL) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                words[high] = word = word ^ low
                if not word:
                    top ^= bit[high]
            if pair[at] != rank:  # a merge has made this entry stale
                continue
            gone = following[at]
            end = following[at] = following[gone]
            pair[gone] = pair[at] = None
            left = before[at]
            if end < n:
                before[end] = at
                pair[at] = new = rank_of(piece[at : following[end]])
                changed = ((new, at),) if left < 0 else ((new, at), (rank_of(piece[left:end]), left))
            else:
                changed = () if left < 0 else ((rank_of(piece[left:end]), left),)
            for new, where in changed:
                pair[where] = new
                if new is None:
                    continue
                if new in buckets:
                    heappush(buckets[new], where)
                    continue
                buckets[new] = [where]
                high = new >> LEVEL
                words[high] |= bit[new & low_bits]
                top |= bit[high]
        starts, at = [], 0
        while at < n:
            starts.append(at)
            at = following[at]
        starts.append(n)
        return starts


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = read_ranks(content)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern)
        self.queue = RankQueue(self.ranks)
        self.of_piece: dict[str, bytes] = {}
        self.at_start, self.after_space = _Words(self, ""), _Words(self, " ")
        self.line_feed = self._of_word("\n")

    def encode(self, text: str) -> bytes:
        """Whole texts are cut where a pre-token must end: before a single space, around a single
        line feed, each with something after it that is not white space. The parts have the same
        pre-tokens alone as in the text."""
        even = _UNEVEN.search(text) is None
        out = []
        for line in text.split("\n") if even else _LINE.split(text):
            words = line.split(" ") if even else _WORD.split(line)
            out.append(self.at_start[words[0]])
            out.extend(map(self.after_space.__getitem__, words[1:]))
            out.append(self.line_feed)
        out.pop()
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _of_word(self, word: str) -> bytes:
        of_piece, out = self.of_piece, []
        for piece in self.pieces.findall(word):
            ids = of_piece.get(piece)
            if ids is None:
                ids = b"".join([i.to_bytes(4, "little") for i in self.merge(piece.encode())])
                if len(of_piece) < CACHED_PIECES:
                    of_piece[piece] = ids
            out.append(ids)
        return b"".join(out)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. A byte that is no token of the ranks is an error (KeyError)."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        starts = self.queue.merged(piece)
        return [ranks[piece[a:b]] for a, b in zip(starts, starts[1:])]


class _Words(dict):
    """Ids of words with what precedes them, computed when first asked for."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder._of_word(self.lead + word)
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(content: bytes, pattern: str) -> Encoder:
    """One encoder for each Python worker and rank file."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(content, pattern)
    return _ENCODERS[key]


def _mapped(docs: DataFrame, path: str, pattern: str, schema: str, names: list[str], row) -> DataFrame:
    """`row(encoder, value)` for the last column of `docs`; the others are passed through."""
    with open(path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [row(encoder, value.as_py()) for value in part.column(part.num_columns - 1)]
                columns = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, _ARROW[row]))],
                    [*part.schema.names[:-1], *names],
                )

    return arrow_map(docs, encode, schema)


def _ids_row(encoder: Encoder, text: str | None):
    ids = memoryview(encoder.encode(text or "")).cast("I").tolist()
    return (ids,)


def _bytes_row(encoder: Encoder, ids: list[int] | None):
    return (encoder.decode(ids or []),)


def _digest_row(encoder: Encoder, text: str | None):
    ids = encoder.encode(text or "")
    decoded = encoder.decode(memoryview(ids).cast("I").tolist())
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


_ARROW = {
    _ids_row: [pa.list_(pa.int32())],
    _bytes_row: [pa.binary()],
    _digest_row: [pa.int64(), pa.string(), pa.string()],
}


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, ids`: the token ids of each whole text; one row per row of `docs`.

    A null or empty text has no ids. Repeated rows and null ids are rows like others; other columns
    of `docs` are not read. An empty table gives an empty result.
    """
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _mapped(picked, path, pattern, f"doc_id {_type(docs, doc_id)}, ids array<int>", ["ids"], _ids_row)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """`doc_id, bytes` from `doc_id, ids`; null ids give no bytes, an unknown id is an error."""
    picked = encoded.select("doc_id", "ids")
    schema = f"doc_id {_type(encoded, 'doc_id')}, bytes binary"
    return _mapped(picked, path, pattern, schema, ["bytes"], _bytes_row)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256`: encoding and decoding in one pass.

    Cases as in `encode`; no text and no ids leave the Python worker.
    """
    picked = docs.select("doc_id", "text")
    schema = f"doc_id {_type(docs, 'doc_id')}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped(picked, path, pattern, schema, ["n_tokens", "ids_sha256", "decoded_sha256"], _digest_row)


def _type(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def tokenizer() -> tuple[str, str]:
    """The rank file and the pattern of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *tokenizer())
