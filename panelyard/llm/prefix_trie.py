"""Conversation prefix trie by composable monoid fingerprints.

A sequence of turns t_0 .. t_{k-1} has the fingerprint sum g(t_i) * B^i modulo the prime 2^61 - 1,
for two bases B: a monoid, so the fingerprint of a concatenation follows from those of its parts,
shifted by a power of B. A conversation that is the head of one stored conversation followed by the
tail of another gets the fingerprint of each prefix from the running sums of the two stored ones:
no rebuilt text is written. Prefixes with one fingerprint and depth are one node of the trie. That
the members of a node really start alike is verified through the turns they point to: every node
has one parent and one last turn, compared as stored turn references (and their texts where the
references differ). Subtree totals come from the members: a member adds to each node on its path
what lies below it, so no node's descendants are ever listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.llm.store import arrow_map, ship_package, stored, table

# The prime modulus and two bases of the fingerprints.
PRIME = (1 << 61) - 1
BASES = (1_000_003, 998_244_353_017)
#: Source conversations a member's head comes from: c - c % 5; head length: crc32(c) % 9.
FAMILY, MOST_HEAD = 5, 9

NODE_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _times_power(g: pd.Series, i: pd.Series, base: int) -> pd.Series:
    return pd.Series([(int(x) * pow(base, int(k), PRIME)) % PRIME for x, k in zip(g, i)], dtype="int64")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """`conv_id, idx, role, text`: turns numbered from 0 by turn (nulls first), then role and text;
    a null role or text is empty; rows of a null conversation are left out."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("idx", F.row_number().over(order) - 1).drop("turn")


def running_sums(turns: DataFrame) -> DataFrame:
    """`conv_id, k, s1, s2`: fingerprints of the first k turns of each conversation, k from 0."""
    from pyspark.sql.functions import pandas_udf

    spark = turns.sparkSession
    weighted = []
    for n, base in enumerate(BASES, 1):
        udf = pandas_udf(lambda g, i, base=base: _times_power(g, i, base), "long")
        weighted.append(udf(F.pmod(F.xxhash64(F.lit(n), "role", "text"), F.lit(PRIME)), F.col("idx")).alias(f"w{n}"))
    ship_package(spark)
    w = turns.select("conv_id", "idx", *weighted)
    run = Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = w.select(
        "conv_id",
        (F.col("idx") + 1).alias("k"),
        *(F.pmod(F.sum(F.col(f"w{n}").cast("decimal(38,0)")).over(run), F.lit(PRIME)).cast("long").alias(f"s{n}") for n in (1, 2)),
    )
    zero = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))
    return sums.unionByName(zero)


def _shifted(value: Column, shift: Column, n: int) -> Column:
    """value * B^-shift modulo the prime, for shift in 0 .. MOST_HEAD - 1."""
    inverse = F.array(*(F.lit(pow(BASES[n - 1], -j, PRIME)) for j in range(MOST_HEAD)))
    product = value.cast("decimal(19,0)") * F.element_at(inverse, (shift + 1).cast("int")).cast("decimal(19,0)")
    return F.pmod(product, F.lit(PRIME)).cast("long")


def _sha_of_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node then member: one digest of the comma-joined members per node."""
    key, digest, first, out = None, None, True, {"depth": [], "f1": [], "f2": [], "ends_sha256": []}
    for batch in batches:
        cols = batch.to_pydict()
        for d, f1, f2, member in zip(cols["depth"], cols["f1"], cols["f2"], cols["member"]):
            if (d, f1, f2) != key:
                if key is not None:
                    for name, value in zip(out, (*key, digest.hexdigest())):
                        out[name].append(value)
                key, digest, first = (d, f1, f2), hashlib.sha256(), True
            digest.update((b"" if first else b",") + str(member).encode())
            first = False
        if len(out["depth"]) >= 65_536:
            yield pa.RecordBatch.from_pydict(out)
            out = {name: [] for name in out}
    if key is not None:
        for name, value in zip(out, (*key, digest.hexdigest())):
            out[name].append(value)
    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("depth", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("ends_sha256", pa.string())]))


def prefix_trie(conversations: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie of the members' conversations (`NODE_SCHEMA`).

    `conversations` has `conv_id, turn, role, text`; each row of `members` (`member, head_conv,
    head_len, tail_conv, tail_from`) is the conversation made of the first `head_len` turns of
    `head_conv` (all if fewer, none if it is absent) and the turns of `tail_conv` from index
    `tail_from` (0-based) on; `tail_from` less the head's used length must lie in 0 .. 8, and member
    ids are distinct. Turns are ordered as `ordered_turns` says. The root (depth 0, no parent) holds every member, turnless ones too. A
    node's `conv_id` is its smallest member; `saved_tokens` sums over its subtree each node's
    (n_convs - 1) times the UTF-8 bytes of its last text; `ends_sha256` hashes the comma-joined ids
    of members that end at it (none: the empty string's digest). Members with a null id are left
    out. No members: no rows. Raises if two different
    prefixes share a fingerprint.
    """
    turns = stored(ordered_turns(conversations), "trie_turns")
    sums = stored(running_sums(turns), "trie_sums")
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    m = members.where(F.col("member").isNotNull()).select("member", "head_conv", "head_len", "tail_conv", "tail_from")
    hl = lengths.select(F.col("conv_id").alias("head_conv"), F.col("n").alias("head_n"))
    tl = lengths.select(F.col("conv_id").alias("tail_conv"), F.col("n").alias("tail_n"))
    m = (
        m.join(hl, "head_conv", "left")
        .join(tl, "tail_conv", "left")
        .withColumn("hb", F.least(F.col("head_len"), F.coalesce("head_n", F.lit(0))))
        .withColumn("own", F.greatest(F.coalesce("tail_n", F.lit(0)) - F.col("tail_from"), F.lit(0)))
    )
    at = lambda who, k, name: sums.select(F.col("conv_id").alias(who), F.col("k").alias(k), F.col("s1").alias(f"{name}1"), F.col("s2").alias(f"{name}2"))
    m = m.join(at("head_conv", "hb", "head"), ["head_conv", "hb"], "left").join(at("tail_conv", "tail_from", "cut"), ["tail_conv", "tail_from"], "left")
    m = m.fillna(0, ["head1", "head2", "cut1", "cut2"])
    m = stored(m.withColumn("length", F.col("hb") + F.col("own")), "trie_members")

    # One row per member and depth; where its turn there comes from and the prefix's fingerprint.
    rows = m.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long"))).alias("depth"))
    in_head = F.col("depth") <= F.col("hb")
    rows = rows.select(
        "member", "depth", "length", "hb", "head1", "head2", "cut1", "cut2", "tail_from",
        F.when(in_head, F.col("head_conv")).otherwise(F.col("tail_conv")).alias("src"),
        F.when(in_head, F.col("depth")).otherwise(F.col("tail_from") + F.col("depth") - F.col("hb")).alias("k"),
    )
    rows = rows.join(sums.withColumnRenamed("conv_id", "src"), ["src", "k"], "left")
    shift = F.col("tail_from") - F.col("hb")
    fps = {
        f"f{n}": F.when(F.col("depth") == 0, F.lit(0).cast("long"))
        .when(F.col("depth") <= F.col("hb"), F.col(f"s{n}"))
        .otherwise(F.pmod(F.col(f"head{n}") + _shifted(F.pmod(F.col(f"s{n}") - F.col(f"cut{n}"), F.lit(PRIME)), shift, n), F.lit(PRIME)))
        for n in (1, 2)
    }
    path = Window.partitionBy("member").orderBy("depth")
    rows = rows.select("member", "depth", "length", "src", (F.col("k") - 1).alias("sidx"), *(v.alias(k) for k, v in fps.items()))
    rows = rows.withColumns({"p1": F.lag("f1").over(path), "p2": F.lag("f2").over(path)})
    size = turns.select(F.col("conv_id").alias("src"), F.col("idx").alias("sidx"), F.octet_length("text").cast("long").alias("bytes"))
    rows = stored(
        rows.join(size, ["src", "sidx"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long")),
        "trie_rows",
    )

    key = ["depth", "f1", "f2"]
    nodes = rows.groupBy(*key).agg(
        F.min("member").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends"),
        F.min(F.struct("p1", "p2")).alias("p_lo"),
        F.max(F.struct("p1", "p2")).alias("p_hi"),
        F.min(F.struct("src", "sidx")).alias("r_lo"),
        F.max(F.struct("src", "sidx")).alias("r_hi"),
    )
    nodes = stored(nodes, "trie_nodes")
    _verify(nodes, rows, turns, key)

    # Per member and depth: is it the node's smallest member, is the node a leaf; sums to the end.
    flags = nodes.select(*key, F.col("conv_id").alias("rep"), (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    below = Window.partitionBy("member").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_rep = F.col("member") == F.col("rep")
    path_sums = rows.join(flags, key).select(
        *key,
        F.sum("bytes").over(below).alias("sb"),
        F.sum(F.when(is_rep, F.col("bytes")).otherwise(0)).over(below).alias("sr"),
        F.sum((is_rep & F.col("leaf")).cast("long")).over(below).alias("lf"),
    )
    totals = path_sums.groupBy(*key).agg((F.sum("sb") - F.sum("sr")).alias("saved_tokens"), F.sum("lf").alias("n_leaves"))
    children = nodes.where("depth > 0").groupBy(F.col("depth") - 1, F.col("p_lo.p1"), F.col("p_lo.p2")).count().toDF(*key, "n_children")
    parents = nodes.select((F.col("depth") + 1).alias("c_depth"), F.col("f1").alias("pp1"), F.col("f2").alias("pp2"), F.col("conv_id").alias("parent_conv_id"))
    ends = rows.where(F.col("depth") == F.col("length")).select(*key, "member").repartition(*key).sortWithinPartitions(*key, "member")
    digests = arrow_map(ends, _sha_of_ends, "depth long, f1 long, f2 long, ends_sha256 string")
    out = (
        nodes.join(totals, key, "left")
        .join(children, key, "left")
        .join(parents, (F.col("depth") == F.col("c_depth")) & (F.col("p_lo.p1") == F.col("pp1")) & (F.col("p_lo.p2") == F.col("pp2")), "left")
        .join(digests, key, "left")
    )
    return out.select(
        F.col("conv_id").cast("long"),
        F.col("depth").cast("long"),
        F.col("parent_conv_id").cast("long"),
        F.col("n_convs").cast("long"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"),
    )


def _verify(nodes: DataFrame, rows: DataFrame, turns: DataFrame, key: list[str]) -> None:
    """Members of a node share its parent, and its last turn: by reference, else by text."""
    mixed_parents = nodes.where(F.col("p_lo") != F.col("p_hi")).limit(1).count()
    differ = nodes.where((F.col("depth") > 0) & (F.col("r_lo") != F.col("r_hi"))).select(*key)
    refs = rows.join(differ, key).select(*key, "src", "sidx").distinct()
    texts = turns.select(F.col("conv_id").alias("src"), F.col("idx").alias("sidx"), "role", "text")
    unequal = (
        refs.join(texts, ["src", "sidx"])
        .groupBy(*key)
        .agg(F.min(F.struct("role", "text")).alias("lo"), F.max(F.struct("role", "text")).alias("hi"))
        .where(F.col("lo") != F.col("hi"))
        .limit(1)
        .count()
    )
    if mixed_parents or unequal:
        raise RuntimeError("two different conversation prefixes share a fingerprint")


def rebuilt_members(conversations: DataFrame) -> DataFrame:
    """Every conversation id c as a member: the first crc32(c) % 9 turns of c - c % 5, then the
    turns of c after as many of its own."""
    ids = conversations.where(F.col("conv_id").isNotNull()).select("conv_id").distinct()
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD
    return ids.select(
        F.col("conv_id").alias("member"),
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head_conv"),
        head.alias("head_len"),
        F.col("conv_id").alias("tail_conv"),
        head.alias("tail_from"),
    )


def op13_prefix_trie_of(conversations: DataFrame) -> DataFrame:
    conversations = conversations.select("conv_id", "turn", "role", "text")
    return prefix_trie(conversations, rebuilt_members(conversations))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_prefix_trie_of(table(spark, sf_dir, "conversations"))
