"""Conversation structure repair by a four-state edit model, reconstructed in linear space.

A repaired conversation has role initials `(s?(ua)+)?`. Its grammar has four states: start, after a
system turn, after a user turn (an assistant must follow), after an assistant turn (may end). Each
row is kept (0), given role user or assistant (3) or deleted (4); blank and repeated rows must go.
Empty user or assistant turns may be inserted anywhere (3); a truncated row that stays costs 3 more.

The cheapest edits and, among them, the ASCII-least audit string are found Hirschberg's way: the
backward four-state cost vector of the right half meets the forward costs of the left half in the
middle of the conversation; the left half is solved with those costs as its end, giving its least
audit and the states in which it ends; the right half starts from them. Each half recurses, so only
a few four-state vectors are held at a time. Left audits all end with a row's edit, so none is a
prefix of another and the least left audit starts the least whole one.

Conversations are grouped by id and each is repaired in one Python task (`applyInPandas`); their
faults, counts and gaps are the same pass.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.store import ship_package, table

#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_INF = float("inf")
#: Grammar states and transitions by emitted role initial.
START, AFTER_S, AFTER_U, AFTER_A = 0, 1, 2, 3
_NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
_ACCEPT = (START, AFTER_A)
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL_PAIRS = {"su", "ua", "au"}

RESULT_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
)


def faults(rows: list[tuple[str, str]]) -> list[str | None]:
    """First fault of each (role, text): 'blank', 'duplicate', 'truncated' or None."""
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(_SPACE)
        if not core:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif core[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append(None)
        seen.add((role, text))
    return out


def _row_moves(role: str, fault: str | None) -> list[tuple[str, str | None, int]]:
    """(audit letter, emitted initial or None, cost) of the edits allowed for one row."""
    moves = [("D", None, DELETE)]
    if fault in ("blank", "duplicate"):
        return moves
    extra = TRUNCATED if fault == "truncated" else 0
    moves.append(("K", role[:1], KEEP + extra))
    moves += [("R", "u", REROLE + extra), ("R", "a", REROLE + extra)]
    return moves


def _closure(after: list[float]) -> list[float]:
    """Cost-to-go before the inserts at a position, from that after them."""
    cost = list(after)
    for _ in range(4):
        for q in range(4):
            for r in "ua":
                if (nxt := _NEXT.get((q, r))) is not None:
                    cost[q] = min(cost[q], INSERT + cost[nxt])
    return cost


class _Repair:
    def __init__(self, rows: list[tuple[str, str]]):
        self.rows, self.faults = rows, faults(rows)
        self.moves = [_row_moves(role, f) for (role, _), f in zip(rows, self.faults)]
        self.end = _closure([0 if q in _ACCEPT else _INF for q in range(4)])

    def _back(self, pos: int, cost_next: list[float]) -> list[float]:
        after = [_INF] * 4
        for q in range(4):
            for _, initial, c in self.moves[pos]:
                nxt = q if initial is None else _NEXT.get((q, initial))
                if nxt is not None:
                    after[q] = min(after[q], c + cost_next[nxt])
        return _closure(after)

    def backward(self, lo: int, hi: int, tail: list[float]) -> list[float]:
        cost = tail
        for pos in range(hi - 1, lo - 1, -1):
            cost = self._back(pos, cost)
        return cost

    def solve(self, lo: int, hi: int, starts: dict[int, float], tail: list[float], final: bool) -> tuple[str, dict[int, float]]:
        """Least audit over rows [lo, hi) from `starts` (state: cost so far), `tail` the cost-to-go
        at hi; `final` adds the inserts after the last row."""
        if hi - lo <= 1:
            return self._greedy(lo, hi, starts, tail, final)
        mid = (lo + hi) // 2
        left, at_mid = self.solve(lo, mid, starts, self.backward(mid, hi, tail), False)
        right, ends = self.solve(mid, hi, at_mid, tail, final)
        return left + right, ends

    def _greedy(self, lo: int, hi: int, starts: dict[int, float], tail: list[float], final: bool) -> tuple[str, dict[int, float]]:
        cost_at = {hi: tail}
        for pos in range(hi - 1, lo - 1, -1):
            cost_at[pos] = self._back(pos, cost_at[pos + 1])
        best = min(g + cost_at[lo][q] for q, g in starts.items())
        nodes, pos, audit = {q: g for q, g in starts.items() if g + cost_at[lo][q] == best}, lo, []
        while True:
            if pos == hi and (not final or any(q in _ACCEPT and g == best for q, g in nodes.items())):
                if final:
                    nodes = {q: g for q, g in nodes.items() if q in _ACCEPT and g == best}
                return "".join(audit), nodes
            options = []
            for q, g in nodes.items():
                for r in "ua":
                    if (nxt := _NEXT.get((q, r))) is not None and g + INSERT + cost_at[pos][nxt] == best:
                        options.append(("I", pos, nxt, g + INSERT))
                if pos < hi:
                    for letter, initial, c in self.moves[pos]:
                        nxt = q if initial is None else _NEXT.get((q, initial))
                        if nxt is not None and g + c + cost_at[pos + 1][nxt] == best:
                            options.append((letter, pos + 1, nxt, g + c))
            letter = min(o[0] for o in options)
            chosen = [o for o in options if o[0] == letter]
            audit.append(letter)
            pos, nodes = chosen[0][1], {o[2]: o[3] for o in chosen}

    def run(self) -> tuple[int, str, list[tuple[str, str]]]:
        """Least cost, its ASCII-least audit and the repaired (role, text) rows."""
        n = len(self.rows)
        if n == 0:
            return 0, "", []
        audit, ends = self.solve(0, n, {START: 0}, self.end, True)
        return int(min(ends.values())), audit, self.replay(audit)

    def replay(self, audit: str) -> list[tuple[str, str]]:
        """The rows an audit gives: roles of rerolled and inserted rows follow from the grammar."""
        out, pos = [], 0
        for letter in audit:
            if letter in "KR":
                role, text = self.rows[pos]
            if letter == "D":
                pos += 1
                continue
            system_first = bool(out) and out[0][0][:1] == "s"
            expected = "user" if (len(out) - system_first) % 2 == 0 else "assistant"
            if letter == "K":
                out.append((role, text))
                pos += 1
            elif letter == "R":
                out.append((expected, text))
                pos += 1
            else:
                out.append((expected, ""))
        return out


def repair_rows(rows: list[tuple[str, str]]) -> dict:
    """Counts, cost, audit and repaired text of one conversation's (role, text) rows in order."""
    fixer = _Repair(rows)
    initials = [role[:1] for role, _ in rows]
    cost, audit, repaired = fixer.run()
    return {
        "blank": fixer.faults.count("blank"),
        "duplicate": fixer.faults.count("duplicate"),
        "truncated": fixer.faults.count("truncated"),
        "illegal": sum(a + b not in _LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired": "\n".join(f"{role}:{text}" for role, text in repaired),
    }


def _repair_group(frame: pd.DataFrame) -> pd.DataFrame:
    keyed = sorted(
        zip(frame["turn"], frame["role"], frame["text"]),
        key=lambda r: (not pd.isna(r[0]), 0 if pd.isna(r[0]) else int(r[0]), r[1], r[2]),
    )
    turns = {int(t) for t, _, _ in keyed if not pd.isna(t)}
    found = repair_rows([(role, text) for _, role, text in keyed])
    conv = frame["conv_id"].iloc[0]
    found |= {"conv_id": None if pd.isna(conv) else int(conv), "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0}
    return pd.DataFrame([found])


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired` per conversation.

    Rows are ordered by turn (nulls first), ties by role and text. A null role or text counts as
    one space. Rows of a null conversation id are one conversation. `repaired` is `role:text` of
    the repaired rows joined by newlines (empty when nothing stays). Other columns are not read.
    An empty table gives no rows.
    """
    ship_package(rows.sparkSession)
    clean = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    return clean.groupBy("conv_id").applyInPandas(_repair_group, RESULT_SCHEMA)


def damage_code(conv_id: Column, turn: Column) -> Column:
    """crc32 of `conv_id:turn` modulo 20; a null part reads as one space."""
    key = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    return F.crc32(key.cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: 0 drops a row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4
    makes it a user turn. Nulls of role and text are one space first."""
    code = damage_code(F.col("conv_id"), F.col("turn"))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), code.alias("d")
    ).where("d <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(conversations))
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(found.withColumnRenamed("conv_id", "_id"), ids["conv_id"].eqNullSafe(F.col("_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        "conv_id",
        *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"),
    )
