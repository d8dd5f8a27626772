"""Places of regex matches in texts, in code points, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose places are added up in one go; longer lists are added up chunk by chunk.
CHUNK = 128
_SPANS = "array<struct<start:bigint,end:bigint>>"


def places(between: Column, whole: Column) -> Column:
    """Spans of the matches `whole`, from the texts between them (one more): a running sum of
    lengths, in chunks so that long lists do not cost the square of their length."""
    steps = F.slice(
        F.zip_with(between, whole, lambda b, m: F.struct(F.length(b).cast("long").alias("b"), F.length(m).cast("long").alias("m"))),
        F.lit(1),
        F.size(whole),
    )
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)),
    )
    totals = F.transform(
        chunks, lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda n, s: n + s["b"] + s["m"])
    )
    offsets = F.aggregate(
        totals,
        F.array(F.lit(0).cast("long")),
        lambda done, total: F.concat(done, F.array(F.element_at(done, -1) + total)),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def placed(chunk: Column, offset: Column) -> Column:
        return F.aggregate(
            chunk,
            start,
            lambda done, s: F.struct(
                (done["at"] + s["b"] + s["m"]).alias("at"),
                F.concat(
                    done["out"],
                    F.array(
                        F.struct(
                            (done["at"] + s["b"] + offset).alias("start"), (done["at"] + s["b"] + s["m"] + offset).alias("end")
                        )
                    ),
                ).alias("out"),
            ),
            lambda done: done["out"],
        )

    return F.flatten(F.zip_with(chunks, F.slice(offsets, F.lit(1), F.size(chunks)), placed))


def with_matches(df: DataFrame, text: str, rules: dict[str, tuple[str, int]], when: dict[str, Column]) -> DataFrame:
    """`df` with a column `<kind>_found` for each rule: `start, end, whole, part` of its matches.

    `rules`: pattern and the number of the group that `part` is. Leftmost matches that do not overlap,
    as the regex engine finds them. `when` says in which rows to look at all.
    """
    found = df.withColumns(
        {
            f"_{kind}_whole": F.when(when[kind], F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
            for kind, (pattern, _) in rules.items()
        }
    )
    some = {kind: F.coalesce(F.size(f"_{kind}_whole") > 0, F.lit(False)) for kind in rules}
    parts = {}
    for kind, (pattern, group) in rules.items():
        parts[f"_{kind}_between"] = F.when(some[kind], F.split(F.col(text), pattern, -1))
        if group:
            parts[f"_{kind}_part"] = F.when(some[kind], F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)))
    found = found.withColumns(parts)
    found = found.withColumns(
        {
            f"_{kind}_spans": F.when(some[kind], places(F.col(f"_{kind}_between"), F.col(f"_{kind}_whole")))
            for kind in rules
        }
    )
    lists = {}
    for kind, (_, group) in rules.items():
        part = f"_{kind}_part" if group else f"_{kind}_whole"
        zipped = F.arrays_zip(F.col(f"_{kind}_spans").alias("s"), F.col(f"_{kind}_whole").alias("w"), F.col(part).alias("p"))
        lists[f"{kind}_found"] = F.when(
            some[kind],
            F.transform(
                zipped,
                lambda z: F.struct(
                    z["s"]["start"].alias("start"), z["s"]["end"].alias("end"), z["w"].alias("whole"), z["p"].alias("part")
                ),
            ),
        ).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,whole:string,part:string>>"))
    return found.withColumns(lists).drop(
        *(f"_{kind}_{x}" for kind in rules for x in ("whole", "between", "part", "spans"))
    )


def tagged(kept: dict[str, Column]) -> Column:
    """The spans of all kinds as one list, by start, then in the order of the kinds."""
    def named(order: int, kind: str):
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")
        )

    every = [F.transform(spans, named(order, kind)) for order, (kind, spans) in enumerate(kept.items())]
    return F.array_sort(F.concat(*every))


def joined(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
