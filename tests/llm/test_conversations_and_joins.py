"""N-gram Jaccard join, conversation repair and the prefix trie against plain Python versions."""

import random
import sys
from pathlib import Path

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelyard.llm import conversation_repair, ngram_join, prefix_trie

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
TRIE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
REPAIR_COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversation_rows(path):
    frame = pq.read_table(f"{path}/conversations.parquet").to_pandas()
    return [
        (None if pd.isna(c) else int(c), None if pd.isna(t) else int(t), r, x)
        for c, t, r, x in frame[["conv_id", "turn", "role", "text"]].itertuples(index=False)
    ]


def conversations(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("audit", df["role"]).withColumn("depth", df["turn"]) if extra else df


# N-gram Jaccard join


@pytest.mark.parametrize("block", [2048, 2])
def test_ngram_join_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op11_ngram_join(spark, SMALL).collect()}
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pandas()
    assert got == brute.jaccard_components(list(zip(docs.doc_id, docs.text)))


def test_ngram_join_edges(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    base = " ".join(f"w{i}" for i in range(40))
    near = base.replace("w20", "x20")  # 4 of 37 shingles differ: 33 / 41 < 0.85
    close = base + " w40"  # 37 of 38: links
    rows = [
        (1, base), (2, base.upper().lower()), (3, close), (4, near), (5, None), (6, ""), (7, "  \t\n"),
        (8, "One two"), (9, "one  TWO"), (10, "one two three four five"), (None, base), (11, base * 50),
        (12, " ".join(f"v{i}" for i in range(20_000))), (13, " ".join(f"v{i}" for i in range(20_001))), (1, base),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect() if r.doc_id is not None)
    want = brute.jaccard_components([(i, t) for i, t in rows if i is not None])
    assert got == sorted((i, *want[i]) for i, _ in rows if i is not None)
    assert dict((i, c) for i, _, c in got)[5] == 5 and dict((i, c) for i, _, c in got)[6] == 6
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def test_ngram_join_rebuilds_no_set_for_a_common_passage(spark, monkeypatch):
    """Texts that meet in a few n-grams fail the position bound; near copies pass it. All are
    found with the least blocks, where most pairs are left to the second round."""
    monkeypatch.setattr(ngram_join, "BLOCK", 1)
    rebuilt = []
    whole = ngram_join._full_sets
    monkeypatch.setattr(ngram_join, "_full_sets", lambda texts, shingle: rebuilt.append(texts.count()) or whole(texts, shingle))
    # Every two of eight texts have one passage in common.
    passages = [[f"{min(i, j)}x{max(i, j)}w{k}" for j in range(8) if j != i for k in range(40)] for i in range(8)]
    odd = [(i, " ".join(p)) for i, p in enumerate(passages)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in odd}
    assert sum(rebuilt) == 0

    words = random.Random(7)
    near = []
    for g in range(12):
        base = [f"g{g}x{words.randrange(90)}" for _ in range(120)]
        for k in range(6):
            text = list(base)
            for _ in range(words.randrange(7)):
                text[words.randrange(len(text))] = f"y{words.randrange(5)}"
            near.append((100 + 6 * g + k, " ".join(text[: 120 - 3 * k])))
    rows = odd + near
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_components(rows)


# Conversation repair


def test_repair_matches_forward_programme():
    rng = random.Random(7)
    roles = ["user", "assistant", "system", " ", "tool", "", "u"]
    texts = ["Hi.", "hi", "", "  ", "What?", "ok!", "Fine", "Hi."]
    for _ in range(3000):
        rows = [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(0, 9))]
        want = brute.repair_forward(rows) if rows else None
        got = conversation_repair.repair_rows(rows)
        if want is None:
            assert (got["cost"], got["audit"], got["repaired"]) == (0, "", "")
        else:
            assert got == want, rows


def test_repair_long_conversation_is_linear():
    rows = [("user" if i % 3 else "system", f"turn {i}.") for i in range(20_000)]
    got = conversation_repair.repair_rows(rows)
    assert len(got["audit"]) >= 20_000 and got["cost"] > 0


@pytest.mark.parametrize("path", [SMALL, MEDIUM])
def test_repair_query_matches_plain_python(spark, path):
    got = conversation_repair.op12_conversation_repair(spark, path).toPandas()
    want = brute.repair_query(conversation_rows(path))
    assert len(got) == len(want)
    for r in got.itertuples(index=False):
        assert {k: getattr(r, k) for k in REPAIR_COLUMNS} == want[r.conv_id]


def test_repair_nulls_empties_and_clashes(spark):
    rows = [(1, None, None, None), (1, 2, "user", "Hello."), (1, 2, "assistant", "Hi"), (2, 5, "user", "x."), (None, 1, "user", "A.")]
    df = conversations(spark, rows)
    got = {r.conv_id: r for r in conversation_repair.repair(df).collect()}
    want = {}
    for c in (1, 2, None):
        mine = sorted([(t, " " if r is None else r, " " if x is None else x) for cc, t, r, x in rows if cc == c], key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        want[c] = brute.repair_forward([(r, x) for _, r, x in mine])
    for c, v in want.items():
        assert (got[c].cost, got[c].audit, got[c].repaired) == (v["cost"], v["audit"], v["repaired"])
    assert conversation_repair.repair(df.limit(0)).count() == 0


# Prefix trie


@pytest.mark.parametrize("path", [SMALL, MEDIUM])
def test_trie_matches_all_prefixes(spark, path):
    got = sorted(tuple(r) for r in prefix_trie.op13_prefix_trie(spark, path).select(TRIE_COLUMNS).collect())
    want = sorted(tuple(v[k] for k in TRIE_COLUMNS) for v in brute.trie(conversation_rows(path)).values())
    assert got == want


def test_trie_nulls_absent_heads_and_repeats(spark):
    rows = [
        (0, 1, "user", "Hello."), (0, 2, "assistant", None), (0, None, None, "first"), (1, 1, "user", "Hello."),
        (3, 1, "user", "Hello."), (3, 1, "user", "Hello."), (7, 4, "system", "S"), (12, 1, None, None), (None, 1, "user", "x"),
        (20, 1, "user", "Hello."), (25, 1, "user", "Hello."),
    ]
    got = sorted(tuple(r) for r in prefix_trie.op13_prefix_trie_of(conversations(spark, rows)).select(TRIE_COLUMNS).collect())
    want = sorted(tuple(v[k] for k in TRIE_COLUMNS) for v in brute.trie(rows).values())
    assert got == want
    assert prefix_trie.op13_prefix_trie_of(conversations(spark, rows).limit(0)).count() == 0
