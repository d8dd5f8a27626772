"""Toxicity by a classifier that is regularised with counterfactuals.

A logistic model on the letter sequences of a document's different words, once, twice and three
times, is fitted to labelled documents. For each that names a group of people a counterfactual is made, in
which every identity term is swapped for the next term of its kind, and the loss holds the squared
change of the score between the two. A group mention alone then moves the score little.

The fit takes a bounded sample of the labelled documents (`SAMPLE`, about) and of their features
(`FEATURES`), so what reaches the driver is bounded; every document is scored over its whole text,
in the tasks that read it, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.store import arrow_map, stored, table

#: Labelled documents (about) and features that the fit takes at most.
SAMPLE, FEATURES = 10_000, 4096
#: A feature is a candidate from so many sampled documents and so large a likelihood ratio.
LEAST_DOCS, LEAST_RATIO = 3, 10.83
#: Weights of the squared score change and of the squared coefficients.
COUNTERFACTUAL, RIDGE = 1.0, 2e-4
#: Lengths of the letter sequences; how often a sequence counts.
LETTERS, LEVELS = (5, 7), 3
#: Words a worker remembers at most, and the longest of them.
CACHED_WORDS, CACHED_LENGTH = 400_000, 40

#: Identity terms of one kind in a row; each is swapped for the next.
IDENTITY_TERMS = (
    ("woman", "man"), ("women", "men"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "chinese"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"),
    ("deaf", "blind", "disabled"), ("old", "young"),
    ("frau", "mann"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwule", "lesben"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAPS = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}

_LETTER_RUN = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> set[str]:
    """Letter sequences of a lower-case word with its borders, by length (or all of a shorter one)."""
    found = set()
    for letters in _LETTER_RUN.findall(word):
        bounded = f"^{letters}$"
        for n in LETTERS:
            found.update(bounded[i : i + n] for i in range(max(1, len(bounded) - n + 1)))
    return found


def text_features(text: str | None) -> set[str]:
    """Each sequence of the text's different words, and "s2", "s3" for one of 2 or 3 words at least."""
    counts = Counter()
    for word in set((text or "").lower().split()):
        counts.update(word_features(word))
    return {level for name, n in counts.items() for level in _levels(name, n)}


def _levels(name: str, n: int) -> list[str]:
    return [name, *(f"{name}{k}" for k in range(2, min(n, LEVELS) + 1))]


def swapped(text: str) -> str | None:
    """The counterfactual of a text; None if it names no group."""
    lower = text.lower()
    if not SWAPS.keys() & set(_LETTER_RUN.findall(lower)):
        return None
    return _LETTER_RUN.sub(lambda m: SWAPS.get(m[0], m[0]), lower)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, counterfactual: float = COUNTERFACTUAL) -> dict[str, float]:
    """Coefficients by feature; "" holds the constant.

    Labels of held-out ids, null labels and labels without a document are not read; a repeated label
    is one, contradicting labels are two rows. Without labelled documents every score is near 0.
    """
    usable = stored(
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", (F.col("toxic") > 0).alias("toxic"))
        .distinct(),
        "labels",
    )
    n = usable.count()
    share = min(1.0, SAMPLE / max(n, 1))
    chosen = stored(
        usable.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), "sample"
    )
    # About SAMPLE ids, whatever the input: a bounded side.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    rows = stored(arrow_map(texts, _sample_rows, "toxic boolean, own array<string>, other array<string>"), "features")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    size = rows.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("int"))).first()
    n, n_toxic = size[0], size[1] or 0
    if not n:
        return {"": -20.0}
    names = sorted(r["feature"] for r in _informative(rows, n, n_toxic).collect())
    # At most FEATURES names, and of each sampled row the numbers of those it has.
    numbers = F.broadcast(docs.sparkSession.createDataFrame([*enumerate(names)], "number int, feature string"))
    found = {}
    for side in ("own", "other"):
        pairs = rows.select("row", F.explode(side).alias("feature")).join(numbers, "feature")
        found[side] = pairs.groupBy("row").agg(F.collect_list("number").alias(f"{side}_numbers"))
    sample = (
        rows.select("row", "toxic", F.col("other").isNotNull().alias("has_other"))
        .join(found["own"], "row", "left")
        .join(found["other"], "row", "left")
        .orderBy("row")
        .toArrow()
    )
    paired = sample["has_other"].to_pylist()
    weights = fit(
        _arrays(sample["own_numbers"]),
        [x if pair else None for x, pair in zip(_arrays(sample["other_numbers"]), paired)],
        np.array(sample["toxic"].to_pylist(), float),
        len(names),
        counterfactual,
    )
    return {"": float(weights[-1])} | {name: float(w) for name, w in zip(names, weights)}


def _arrays(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """One array per row; null is empty."""
    flat = lists.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):  # no chunk at all
        return []
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            texts = [t.as_py() or "" for t in part.column(1)]
            others = [swapped(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([sorted(text_features(t)) for t in texts], pa.list_(pa.string())),
                    pa.array([None if t is None else sorted(text_features(t)) for t in others], pa.list_(pa.string())),
                ],
                ["toxic", "own", "other"],
            )


def _informative(rows: DataFrame, n: int, n_toxic: int) -> DataFrame:
    """The features whose presence tells most about the label, by likelihood ratio."""
    counts = (
        rows.select("toxic", F.explode("own").alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("int")).alias("k"))
        .where(F.col("n") >= LEAST_DOCS)
    )

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = n_toxic / n
    with_it, without = F.col("n"), F.lit(n) - F.col("n")
    cells = (
        part(F.col("k"), with_it * share)
        + part(with_it - F.col("k"), with_it * (1 - share))
        + part(F.lit(n_toxic) - F.col("k"), without * share)
        + part(without - F.lit(n_toxic) + F.col("k"), without * (1 - share))
    )
    ratio = counts.withColumn("ratio", 2 * cells).where(F.col("ratio") >= LEAST_RATIO)
    return ratio.orderBy(F.desc("ratio"), "feature").limit(FEATURES).select("feature")


def fit(
    own: list[np.ndarray],
    other: list[np.ndarray | None],
    toxic: np.ndarray,
    n_features: int,
    counterfactual: float = COUNTERFACTUAL,
    rounds: int = 400,
) -> np.ndarray:
    """Coefficients and the constant: mean log loss + ridge + mean squared counterfactual change.

    Toxic rows are the fewer ones and count more, by the root of how much fewer they are.
    """

    def flat(lists):
        return (
            np.repeat(np.arange(len(lists)), [len(x) for x in lists]),
            np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in lists)]),
        )

    row, column = flat(own)
    paired = [i for i, x in enumerate(other) if x is not None]
    # The difference of a pair: features only in the text count 1, only in its counterfactual -1.
    gained = [np.setdiff1d(own[i], other[i]) for i in paired]
    lost = [np.setdiff1d(other[i], own[i]) for i in paired]
    (gain_row, gain_column), (lose_row, lose_column) = flat(gained), flat(lost)
    n, n_pairs = len(own), max(len(paired), 1)
    rate = (toxic.sum() + 0.5) / (n + 1)
    counts = np.where(toxic > 0, max(1.0, ((1 - rate) / rate) ** 0.5), 1.0)
    w = np.zeros(n_features + 1)
    w[-1] = np.log(rate / (1 - rate))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        logit = np.bincount(row, w[column], n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - toxic) * counts / counts.sum()
        change = np.bincount(gain_row, w[gain_column], n_pairs) - np.bincount(lose_row, w[lose_column], n_pairs)
        change = change * (2 * counterfactual / n_pairs)
        slope = np.bincount(column, error[row], n_features + 1)
        slope += np.bincount(gain_column, change[gain_row], n_features + 1)
        slope -= np.bincount(lose_column, change[lose_row], n_features + 1)
        slope[-1] = error.sum()
        slope[:-1] += 2 * RIDGE * w[:-1]
        mean += 0.1 * (slope - mean)
        square += 0.001 * (slope**2 - square)
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return w


class Scorer:
    """Scores of texts; a worker remembers the weighted sequences of the words it has met."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.sequences = {name.rstrip("0123456789") for name in weights if name}
        self.words: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        weights, known = self.weights, self.words
        counts: Counter[str] = Counter()
        for word in set((text or "").lower().split()):
            sequences = known.get(word)
            if sequences is None:
                sequences = tuple(self.sequences & word_features(word))
                if len(known) < CACHED_WORDS and len(word) <= CACHED_LENGTH:
                    known[word] = sequences
            if sequences:
                counts.update(sequences)
        logit = weights[""] + sum(weights.get(level, 0.0) for name in sorted(counts) for level in _levels(name, counts[name]))
        return 1 / (1 + float(np.exp(-np.clip(logit, -500, 500))))


def scored(docs: DataFrame, weights: dict[str, float], keep_text: bool = True) -> DataFrame:
    """`docs` with `score` as a last column (replacing one of that name).

    A null text counts as empty and has the score of the constant alone. Repeated rows score alike.
    An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c != "score" and (keep_text or c != "text")]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            values = [scorer.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array(values, pa.float64())], [*kept, "score"]
            )

    picked = docs.select(*kept, F.col("text").alias("_whole_text"))
    schema = docs.select(kept).schema.add("score", "double")
    return arrow_map(picked, score, schema)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score under 0.5, with the columns of `docs`."""
    return scored(docs, train(docs, labels)).where("score < 0.5").select(docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), weights, keep_text=False).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
