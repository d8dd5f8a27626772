"""Secret scans through a trigram inverted index.

Each rule's regex gives a Boolean query over trigrams that every match must contain. The index holds
postings for the trigrams that rules ask for; a rule's candidates are the intersection and union of
its postings, and only candidates are matched against the regex. A rule without mandatory trigrams
scans every document. DataFrame functions only.
"""

from __future__ import annotations

from re import _constants as kinds
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.spans import joined, tagged, with_matches
from panelyard.llm.store import stored, table

#: Fixed patterns of the base kinds; the second number is the group of `part`. A minimum length of a
#: whole run is in the pattern where that finds the same runs.
BASE_RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": (r"AKIA[A-Z0-9]{16,}", 0),
    "hex": (r"[0-9a-f]{24,}", 0),
}
#: Fixed patterns of the kinds that the scan adds.
MORE_RULES = {
    "private_key": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,255}", 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,255}", 0),
    "google": (r"AIza[0-9A-Za-z_-]{35}", 0),
    "stripe": (r"[rs]k_live_[0-9A-Za-z]{16,255}", 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0),
}
LEAST_VALUE = 6
#: Alternatives of a stretch of a pattern that are spelled out before it is cut.
MOST_SPELLED = 32

#: A query: None (no condition), or ("and" | "or", trigrams, queries).
Query = tuple | None


def trigram_query(pattern: str) -> Query:
    """The condition on trigrams of the lower-cased text that each match of `pattern` meets.

    Stretches of literals, alternatives and small sets are spelled out as strings; each string asks
    for all its trigrams, and alternatives are joined by "or". Repeats of one or more ask for what
    they repeat once; anything else ends a stretch.
    """
    conditions: list[Query] = []
    last = _walk(_parser.parse(pattern), [""], conditions)
    conditions.append(_asks(last))
    return _both(conditions)


def _asks(strings: list[str]) -> Query:
    each = []
    for s in strings:
        trigrams = sorted({s[i : i + 3] for i in range(len(s) - 2)})
        if not trigrams:
            return None
        each.append(("and", trigrams, []))
    return each[0] if len(each) == 1 else ("or", [], each)


def _both(conditions: list[Query]) -> Query:
    asked = [c for c in conditions if c is not None]
    if len(asked) < 2:
        return asked[0] if asked else None
    return ("and", [], asked)


def _walk(parsed, strings: list[str], conditions: list[Query]) -> list[str]:
    """What the current stretch may spell after `parsed`; stretches that end go to `conditions`."""

    def cut() -> list[str]:
        conditions.append(_asks(strings))
        return [""]

    for kind, value in parsed:
        if kind is kinds.LITERAL:
            strings = [s + chr(value).lower() for s in strings]
        elif kind is kinds.SUBPATTERN:
            strings = _walk(value[-1], strings, conditions)
        elif kind is kinds.BRANCH:
            spelled = [_spelled(branch) for branch in value[1]]
            if any(s is None for s in spelled):
                inner = [_both(c) for c in map(_conditions, value[1])]
                strings = cut()
                conditions.append(None if None in inner else ("or", [], inner))
            else:
                strings = _joined(strings, [x for s in spelled for x in s]) or cut()
        elif kind is kinds.IN:
            several = _spelled([(kind, value)])
            strings = (_joined(strings, several) if several else None) or cut()
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = _spelled(inner)
            if once and least == 0 and most == 1:
                strings = _joined(strings, ["", *once]) or cut()
            elif once and least >= 1:
                strings = _joined(strings, once) or cut()
                strings = strings if least == most == 1 else cut()
            else:
                strings = cut()
        elif kind is not kinds.AT:
            strings = cut()
    return strings


def _conditions(branch) -> list[Query]:
    found: list[Query] = []
    found.append(_asks(_walk(branch, [""], found)))
    return found


def _spelled(parsed) -> list[str] | None:
    """All strings of a finite pattern, lower-cased; None if they are too many."""
    strings = [""]
    for kind, value in parsed:
        if kind is kinds.LITERAL:
            more = [chr(value).lower()]
        elif kind is kinds.SUBPATTERN:
            more = _spelled(value[-1])
        elif kind is kinds.BRANCH:
            each = [_spelled(b) for b in value[1]]
            more = None if any(e is None for e in each) else [x for e in each for x in e]
        elif kind is kinds.IN and all(k is kinds.LITERAL for k, _ in value):
            more = sorted({chr(c).lower() for _, c in value})
        elif kind is kinds.MAX_REPEAT and value[1] == 1:
            once = _spelled(value[2])
            more = None if once is None else ([""] if value[0] == 0 else []) + once
        else:
            more = None
        strings = more and _joined(strings, more)
        if not strings:
            return None
    return strings


def _joined(before: list[str], after: list[str]) -> list[str] | None:
    both = sorted({a + b for a in before for b in after})
    return both if len(both) <= MOST_SPELLED else None


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return set(query[1]).union(*map(trigrams_of, query[2]))


def holds(query: Query, has) -> Column:
    """The query as a condition; `has(trigram)` says whether a document has one."""
    kind, trigrams, queries = query
    terms = [has(t) for t in trigrams] + [holds(q, has) for q in queries]
    result = terms[0]
    for term in terms[1:]:
        result = result & term if kind == "and" else result | term
    return result


def trigram_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """`trigram, doc_id, text_hash`: the postings of `trigrams` in the lower-cased texts of `docs`."""
    lowered = docs.withColumn("_lower", F.lower("text"))
    present = F.array_compact(F.array(*[F.when(F.contains("_lower", F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = lowered.select("doc_id", "text_hash", F.explode(present).alias("trigram"))
    return stored(postings.sortWithinPartitions("trigram").select("trigram", "doc_id", "text_hash"), "postings")


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """`doc_id, text_hash` and one flag per rule: the documents whose postings meet its query."""
    asked = sorted(set().union(*map(trigrams_of, queries.values())))
    place = {t: f"_has{i}" for i, t in enumerate(asked)}
    found = postings.groupBy("doc_id", "text_hash").agg(
        *[F.max(F.col("trigram") == t).alias(name) for t, name in place.items()]
    )
    flags = [holds(q, lambda t: F.col(place[t])).alias(f"maybe_{rule}") for rule, q in queries.items()]
    flagged = found.select("doc_id", "text_hash", *flags)
    return flagged.where(" OR ".join(f"maybe_{rule}" for rule in queries))


def scan(docs: DataFrame, rules: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """`doc_id` and the list `<kind>_found` (`start, end, whole, part`) for every rule and row.

    A null text counts as empty. Repeated rows get a row each; ids may be null. Other columns are not
    read. An empty table gives an empty result. Matches of a rule do not overlap each other.
    """
    rules = rules or BASE_RULES | MORE_RULES
    queries = {kind: trigram_query(pattern) for kind, (pattern, _) in rules.items()}
    indexed = {kind: q for kind, q in queries.items() if q is not None}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    if indexed:
        asked = sorted(set().union(*map(trigrams_of, indexed.values())))
        flags = candidates(trigram_postings(texts, asked), indexed)
        flags = flags.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
        texts = texts.join(flags, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    when = {kind: F.coalesce(f"maybe_{kind}", F.lit(False)) if kind in indexed else F.lit(True) for kind in rules}
    found = with_matches(texts, "text", rules, when)
    return found.select("doc_id", *(f"{kind}_found" for kind in rules))


def secrets(docs: DataFrame) -> DataFrame:
    """`scan` with the failing matches dropped and the lists joined to digests and spans."""
    found = scan(docs)
    kept = {kind: F.col(f"{kind}_found") for kind in BASE_RULES | MORE_RULES}
    kept["assign"] = F.filter(kept["assign"], lambda m: F.length(m["part"]) >= LEAST_VALUE)
    found = found.select("doc_id", *(spans.alias(kind) for kind, spans in kept.items()))
    base = tagged({kind: F.col(kind) for kind in BASE_RULES})
    every = tagged({kind: F.col(kind) for kind in kept})
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE_RULES),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
