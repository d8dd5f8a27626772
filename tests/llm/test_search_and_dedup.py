"""Top-k search, exact dedup, near-dedup and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import exact_dedup, simhash_dedup, suffix_dedup, top_k
from panelyard.llm.components import components

SMALL = "/root/testdata/sf0.001"


def texts(spark, values, ids=None, extra=True):
    rows = [(i, t, "clash") for i, t in zip(ids or range(len(values)), values)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    return df if extra else df.drop("digest")


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.sql(sql).fetchall()


@pytest.mark.parametrize("tile", [4096, 7])
def test_top_k_matches_sql(spark, monkeypatch, tile):
    monkeypatch.setattr(top_k, "TILE", tile)
    got = top_k.op1_top_k(spark, SMALL).select("query_id", "rank", "vec_id", "score").collect()
    want = oracle(top_k.OP1_SQL, embeddings=f"{SMALL}/embeddings.parquet")
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_nulls_ties_and_repeats(spark):
    rows = [
        (0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]),
        (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [-1e300, 1e300]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("tile", F.lit("clash"))
    got = sorted(map(tuple, top_k.top_k(df, F.col("vec_id") % 100 == 0, k=3).collect()))
    score = 1024 * 1024 + 512 * 512
    assert got == [(0, 1, 1, score), (0, 2, 2, score), (0, 3, 2, score)]
    assert top_k.top_k(df.limit(0), F.lit(True)).count() == 0
    alone = top_k.top_k(df.where("vec_id = 9 OR vec_id = 0"), F.col("vec_id") == 9, k=3).collect()
    assert [tuple(r) for r in alone] == [(9, 1, 0, -(2**63))]


def test_exact_dedup_matches_sql(spark):
    got = exact_dedup.op2_exact_dedup(spark, SMALL).collect()
    want = oracle(exact_dedup.OP2_SQL, documents=f"{SMALL}/documents.parquet")
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_dedup_cases(spark):
    df = texts(spark, ["a", "a", None, "", "b", "b", "x" * 100_000], [1, 5, 2, 3, 7, 7, 9])
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {(1, 5, 2, False), (5, 5, 2, True), (2, 3, 2, False), (3, 3, 2, True), (7, 7, 2, True), (9, 9, 1, True)}
    kept = exact_dedup.kept_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 7, 9]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_digest_index_takes_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first = exact_dedup.exact_dedup(texts(spark, ["a", "b"], [1, 2]), index).where("kept").collect()
    second = exact_dedup.exact_dedup(texts(spark, ["b", "c", "c"], [10, 11, 12]), index)
    got = sorted((r.doc_id, r.keep_id, r.kept) for r in second.collect())
    assert len(first) == 2 and got == [(10, 2, False), (11, 12, False), (12, 12, True)]
    assert index.read().count() == 3


def test_golay_keys_find_all_links():
    tables, rng = simhash_dedup.golay_tables(), np.random.default_rng(1)
    left = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    right = left.copy()
    for i in range(len(right)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            right[i] ^= np.uint64(1) << np.uint64(bit)
    key, owner, nearest = simhash_dedup.fuzzy_keys(left, tables)
    mine = {(int(o), int(k)) for k, o, n in zip(key, owner, nearest) if n}
    key, owner, _ = simhash_dedup.fuzzy_keys(right, tables)
    assert {o for o, k in mine & set(zip(owner.tolist(), key.tolist()))} == set(range(len(left)))


def brute_components(rows):
    fps = {d: simhash_dedup.fingerprint(t) for d, t in rows}
    out = {}
    left = set(fps)
    while left:
        group, todo = set(), [min(left)]
        while todo:
            d = todo.pop()
            group.add(d)
            near = [e for e in left - group if (fps[d] ^ fps[e]).bit_count() <= 3]
            group.update(near)
            todo += near
        out |= {d: (f"{fps[d]:016x}", min(group)) for d in group}
        left -= group
    return out


@pytest.mark.parametrize("block", [4096, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rnd = random.Random(4)
    base = [" ".join(f"w{rnd.randrange(9999)}" for _ in range(400)) for _ in range(3)]
    values = [None, "", " \t\n", "One", "one", "two words", *base]
    for text in base:
        words = text.split()
        for _ in range(25):
            copy = list(words)
            copy[rnd.randrange(400)] = "changed"
            values.append(" ".join(copy))
    values.append("x " * 50_000)
    rows = list(enumerate(values))
    marked = simhash_dedup.near_duplicates(texts(spark, values))
    got = {r.doc_id: (r.fp, r.component_id) for r in marked.select("doc_id", simhash_dedup.hex_digits(F.col("fp")).alias("fp"), "component_id").collect()}
    want = brute_components(rows)
    assert got == want
    kept = simhash_dedup.kept_documents(texts(spark, values))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_near_duplicates_of_repeated_rows_and_nothing(spark):
    df = texts(spark, ["a b c", "a b c", "a b c"], [4, 4, 2])
    assert {(r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(df).collect()} == {(4, 2), (2, 2)}
    assert simhash_dedup.kept_documents(df).count() == 1
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == (
        {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    )


def test_suffix_array_orders_suffixes():
    rnd = random.Random(3)
    for _ in range(200):
        text = bytes(rnd.choice(b"ab\xff") for _ in range(rnd.randrange(60)))
        assert suffix_dedup.suffix_array(text, 100) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(values, length=200):
    octets = [(v or "").encode() for v in values]
    counts = Counter(t[i : i + length] for t in octets for i in range(len(t) - length + 1))
    out = []
    for t in octets:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [1000, 1])
def test_repeats_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", shard)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    values = [None, "", "a" * 700, "a" * 300 + "b" * 250, "ab" * 300, "q" * 199, "é" * 220, passage, passage, passage[:150]]
    for _ in range(12):
        values.append(" ".join(word() for _ in range(40)) + passage[: rnd.randrange(190, 330)] + " ".join(word() for _ in range(30)))
    got = suffix_dedup.without_repeats(texts(spark, values)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(values)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_across_pieces_repeated_rows_and_nothing(spark, monkeypatch):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    values = [long, "x" + long[1000:3000] + "y", "short"]
    joined = list(suffix_dedup._pieces([v.encode() for v in values]))
    assert len(joined) == 1
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    parts = list(suffix_dedup._pieces([v.encode() for v in values]))
    assert sum(len(p) - 199 * (len(m) // 2) for p, m in parts) == 5000 - 199 + 2002 - 199
    df = texts(spark, values + [long], [1, 2, 3, 1])
    got = suffix_dedup.without_repeats(df, keep_bytes=False).collect()
    assert sorted((r.doc_id, r.n_bytes - r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 2), (3, 5)]
    assert suffix_dedup.without_repeats(df.limit(0)).count() == 0
