"""Personal data by patterns, widened by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They are the seeds: the
words around them (the word before, the word after) are lexical patterns. A seed is its whole span,
and words of digits side by side are one candidate. In a graph of patterns and of the seeds and
candidates that they surround, scores go to and fro: a pattern scores by the mean
of its instances, an instance by the chance that one of its patterns is right. Patterns with many
seeds and a high score then mark the unseen identifiers in their place. DataFrame functions only.

What moves between tasks are seeds, candidates and their two neighbours, never texts; pattern
and instance scores are aggregated before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.spans import joined, tagged, with_matches
from panelyard.llm.store import stored, table

#: Fixed patterns of the base kinds. Possessive repeats and the look behind find the same matches as
#: plain ones, in linear time and without recursion.
BASE_RULES = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0),
}
#: A word with a digit or an "@" may hold an identifier; numbers with one space between are one.
SLOT = (r"(?<!\S)(?:[(+]*+[0-9][0-9()./+-]*+\x20(?=[(+]*+[0-9][^\s@A-Za-z]*+(?!\S)))*+[^\s0-9@]*+[0-9@]\S*+", 0)
#: What an unseen identifier must hold; numbers of more digits side by side are several.
LEAST_DIGITS, MOST_DIGITS = 4, 19
#: A pattern counts from so many different seeds, and so high a score; rounds of scoring.
LEAST_SEEDS, LEAST_SCORE, ROUNDS = 5, 0.9, 3

KINDS = tuple(BASE_RULES)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    backwards = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(backwards, i, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    whole = match["whole"]
    if kind == "ip":
        def at_most_255(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+", "")
            return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

        return F.forall(F.split(whole, r"\."), at_most_255)
    if kind == "card":
        number = digits(whole)
        return F.length(number).between(14, 19) & F.when(F.length(number).between(14, 19), passes_luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(whole)).between(10, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """`doc_id, text_hash`, the spans of each base kind, and `slots`: every base span with its kind, and
    every run of identifier-like words outside of them, with the words around."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    some = F.col("text").rlike("[0-9@]")
    when = {
        "email": F.contains("text", F.lit("@")),
        "ip": some & F.contains("text", F.lit(".")),
        "card": some,
        "phone": F.contains("text", F.lit("+")),
        "slot": some,
    }
    found = with_matches(texts, "text", BASE_RULES | {"slot": SLOT}, when)

    def only_valid(kind: str):
        return F.transform(
            F.filter(f"{kind}_found", lambda m: _valid(kind, m)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
        )

    found = found.withColumns({kind: only_valid(kind) for kind in KINDS})

    def word(text: Column, last: bool) -> Column:
        plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
        return F.lower(F.substring_index(F.rtrim(plain) if last else F.ltrim(plain), " ", -1 if last else 1))

    def overlaps(s: Column):
        return lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])

    def slot(start: Column, end: Column, whole: Column, kind: Column) -> Column:
        # The rest of a word that a span begins or ends in is no word around it.
        before = F.substring("text", F.greatest(start - 99, F.lit(1)).cast("int"), F.least(start, F.lit(99)).cast("int"))
        after = F.substring("text", (end + 1).cast("int"), F.lit(99))
        return F.struct(
            start.alias("start"),
            whole.alias("whole"),
            word(F.regexp_replace(before, r"\S+\z", ""), True).alias("left"),
            word(F.regexp_replace(after, r"\A\S+", ""), False).alias("right"),
            kind.alias("kind"),
        )

    def text_of(start: Column, end: Column) -> Column:
        return F.substring("text", (start + 1).cast("int"), (end - start).cast("int"))

    def seeds(place: int) -> Column:
        """The spans of a kind but for those that overlap a span of a kind before it."""
        kind = KINDS[place]
        clear = lambda s: ~reduce(lambda a, b: a | b, [F.exists(k, overlaps(s)) for k in KINDS[:place]], F.lit(False))
        return F.transform(F.filter(kind, clear), lambda s: slot(s["start"], s["end"], text_of(s["start"], s["end"]), F.lit(kind)))

    def outside(s: Column) -> Column:
        """What a run of words has outside of base spans, in whole words."""
        inside = F.filter("_bases", overlaps(s))
        first, last = F.array(s["start"]), F.array(s["end"])
        between = F.zip_with(
            F.concat(first, F.transform(inside, lambda b: b["end"])),
            F.concat(F.transform(inside, lambda b: b["start"]), last),
            lambda a, b: F.struct(a.alias("start"), b.alias("end")),
        )
        between = F.filter(between, lambda p: (p["start"] < p["end"]) & ~F.exists("_bases", overlaps(p)))

        def in_words(p: Column) -> Column:
            whole = text_of(p["start"], p["end"])
            lead = F.when(p["start"] > s["start"], F.length(F.regexp_extract(whole, r"\A\S*+\s*+", 0))).otherwise(0)
            rest = F.substring(whole, lead + 1, F.length(whole))
            rest = F.when(p["end"] < s["end"], F.regexp_replace(rest, r"(?:\A|\s)\S*+\z", "")).otherwise(rest)
            return F.struct((p["start"] + lead).alias("start"), rest.alias("whole"))

        return F.filter(F.transform(between, in_words), lambda p: p["whole"] != "")

    def candidates(p: Column) -> Column:
        whole, start = p["whole"], p["start"]
        end = start + F.length(whole)
        none = F.lit(None).cast("string")
        first, last = F.substring_index(whole, " ", 1), F.substring_index(whole, " ", -1)
        # A longer row of numbers is no identifier: those at its ends are next to words.
        several = (F.length(digits(whole)) > MOST_DIGITS) & F.contains(whole, F.lit(" "))
        ends = F.array(
            slot(start, start + F.length(first), first, none), slot(end - F.length(last), end, last, none)
        )
        return F.when(several, ends).otherwise(F.array(slot(start, end, whole, none)))

    span = lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))
    found = found.withColumn("_bases", F.array_sort(F.concat(*[F.transform(k, span) for k in KINDS])))
    found = found.withColumn("_outside", F.flatten(F.transform("slot_found", outside)))
    slots = F.concat(*map(seeds, range(len(KINDS))), F.flatten(F.transform("_outside", candidates)))
    return found.select("doc_id", "text_hash", *KINDS, slots.alias("slots"))


def pattern_graph(slots: DataFrame) -> DataFrame:
    """`pattern, instance`, and for each kind whether a seed of it was seen so (1 or 0)."""
    sides = F.array(
        F.when(F.col("left") != "", F.concat(F.lit("before:"), "left")),
        F.when(F.col("right") != "", F.concat(F.lit("after:"), "right")),
    )
    seen = slots.select(F.explode(F.array_compact(sides)).alias("pattern"), F.col("core").alias("instance"), "kind")
    return seen.groupBy("pattern", "instance").agg(
        *[F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(k) for k in KINDS]
    )


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`pattern`, its number of seeds and its score for each kind, after `rounds` to and fro.

    Seeds keep the score 1. Every round is one aggregate by instance and one by pattern.
    """
    seeds = edges.groupBy("instance").agg(*[F.max(k).alias(f"seed_{k}") for k in KINDS])
    known = stored(edges.join(seeds, "instance").select("pattern", "instance", *(f"seed_{k}" for k in KINDS)), "edges")
    values = {k: F.col(f"seed_{k}") for k in KINDS}
    scores = None
    for _ in range(rounds):
        if scores is not None:
            guess = known.join(scores, "pattern").groupBy("instance").agg(
                # At least one of the patterns is right; a sum of logs of the chances that none is.
                *[(1 - F.exp(F.sum(F.log1p(-F.least(F.col(f"score_{k}"), F.lit(0.999)))))).alias(f"guess_{k}") for k in KINDS]
            )
            scored = known.join(guess, "instance")
            values = {k: F.greatest(f"seed_{k}", F.col(f"guess_{k}") * F.col(f"score_{k}")) for k in KINDS}
            scored = scored.join(scores.drop(*(f"n_{k}" for k in KINDS)), "pattern")
        else:
            scored = known
        scores = stored(
            scored.groupBy("pattern").agg(
                *[F.sum(f"seed_{k}").alias(f"n_{k}") for k in KINDS], *[F.avg(values[k]).alias(f"score_{k}") for k in KINDS]
            ),
            "pattern_scores",
        )
    return scores


def extract(docs: DataFrame) -> DataFrame:
    """`doc_id`, the spans of each base kind and `added` (`start, end, kind`), for every row.

    Null counts as empty. Repeated rows get a row each; ids may be null; other columns are not read.
    An empty table gives an empty result. Added spans never overlap base ones. A text without seeds
    around gets none.
    """
    base = stored(base_spans(docs), "base_spans")
    slots = base.select("doc_id", "text_hash", F.explode("slots").alias("s")).select("doc_id", "text_hash", "s.*")
    # A bracket stays where it is around the first part of a number.
    lead = F.regexp_extract("whole", r"^(?:(?!\([0-9]++\)\x20?[0-9])[^A-Za-z0-9@+])*+", 0)
    core = F.regexp_extract(F.substring("whole", F.length(lead) + 1, F.length("whole")), r"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]++)++", 0)
    slots = stored(slots.withColumn("core", core).withColumn("from", F.col("start") + F.length(lead)), "slots")
    scores = pattern_scores(pattern_graph(slots))
    sure = scores.where(
        reduce(lambda a, b: a | b, [(F.col(f"n_{k}") >= LEAST_SEEDS) & (F.col(f"score_{k}") >= LEAST_SCORE) for k in KINDS])
    )
    strengths = [
        F.when(F.col(f"n_{k}") >= LEAST_SEEDS, F.struct(F.col(f"score_{k}").alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")))
        for i, k in enumerate(KINDS)
    ]
    best = sure.select("pattern", F.array_max(F.array_compact(F.array(*strengths))).alias("best"))
    unseen = slots.where(
        F.col("kind").isNull() & (F.col("core") != "") & ((F.length(digits(F.col("core"))) >= LEAST_DIGITS) | F.contains("core", F.lit("@")))
    )
    sides = F.array_compact(F.array(F.concat(F.lit("before:"), "left"), F.concat(F.lit("after:"), "right")))
    added = (
        unseen.select("doc_id", "text_hash", "from", F.length("core").alias("n"), F.explode(sides).alias("pattern"))
        .join(best, "pattern")
        .groupBy("doc_id", "text_hash", "from", "n")
        .agg(F.max("best").alias("best"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(
            F.collect_list(
                F.struct(F.col("from").alias("start"), (F.col("from") + F.col("n")).alias("end"), F.col("best.kind").alias("kind"))
            ).alias("added")
        )
    )
    matched = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    return base.join(added, matched, "left").select("doc_id", *KINDS, F.coalesce("added", none).alias("added"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    base = {k: F.col(k) for k in KINDS}
    every = {k: F.concat(F.col(k), F.transform(F.filter("added", _of(k)), _span)) for k in KINDS}
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(tagged(base)).cast("binary"), 256).alias("base_sha256"),
        joined(tagged(every)).alias("spans"),
    )


def _of(kind: str):
    return lambda a: a["kind"] == kind


def _span(a: Column) -> Column:
    return F.struct(a["start"].alias("start"), a["end"].alias("end"))
