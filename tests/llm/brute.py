"""Plain Python versions of the conversation and n-gram operators, for the tests."""

from __future__ import annotations

import hashlib
import re
import zlib

SPACE = " \t\n\x0b\x0c\r"


# N-gram Jaccard join: all pairs.
def shingle_set(text, k=4):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([" ".join(words)])
    return frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard_components(docs, pct=85):
    """{doc_id: (n_shingles, component_id)} by comparing every pair."""
    sets = {}
    for i, t in docs:
        sets[i] = sets.get(i, frozenset()) | shingle_set(t)
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a_pos, a in enumerate(ids):
        for b in ids[a_pos + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


# Conversation repair: forward dynamic programme that keeps the least (cost, audit) per node.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    """rows: (conv_id, turn, role, text) -> rows after damage."""
    out = []
    for c, t, r, x in rows:
        r, x = (" " if r is None else r), (" " if x is None else x)
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        d = zlib.crc32(key.encode()) % 20
        if d == 0:
            continue
        if d == 1:
            x = ""
        elif d == 2:
            x = re.sub(r"[.!?]", "", x)
        elif d == 4:
            r = "user"
        out.append((c, t, r, x))
        if d == 3:
            out.append((c, t, r, x))
    return out


def repair_forward(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired) of (role, text) rows in order."""
    seen, faults = set(), []
    for r, x in rows:
        core = x.strip(SPACE)
        faults.append("blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((r, x))
    inf = (float("inf"), "")

    def relax_inserts(best):
        for _ in range(4):
            for q in range(4):
                if best[q][0] == float("inf"):
                    continue
                for role in "ua":
                    if (n := NEXT.get((q, role))) is not None:
                        cand = (best[q][0] + 3, best[q][1] + "I", best[q][2] + [("user" if role == "u" else "assistant", "")])
                        if (cand[0], cand[1]) < (best[n][0], best[n][1]):
                            best[n] = cand
        return best

    best = relax_inserts([(0, "", [])] + [(inf[0], "", [])] * 3)
    for (r, x), f in zip(rows, faults):
        nxt = [(inf[0], "", [])] * 4
        extra = 3 if f == "truncated" else 0
        for q in range(4):
            c, a, out = best[q]
            if c == float("inf"):
                continue
            moves = [("D", q, 4, None)]
            if f not in ("blank", "duplicate"):
                if (n := NEXT.get((q, r[:1]))) is not None:
                    moves.append(("K", n, extra, (r, x)))
                for role, name in (("u", "user"), ("a", "assistant")):
                    if (n := NEXT.get((q, role))) is not None:
                        moves.append(("R", n, 3 + extra, (name, x)))
            for letter, n, cost, row in moves:
                cand = (c + cost, a + letter, out + ([row] if row else []))
                if (cand[0], cand[1]) < (nxt[n][0], nxt[n][1]):
                    nxt[n] = cand
        best = relax_inserts(nxt)
    cost, audit, out = min((best[q] for q in (0, 3)), key=lambda v: (v[0], v[1]))
    initials = [r[:1] for r, _ in rows]
    return {
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired": "\n".join(f"{r}:{x}" for r, x in out),
    }


def repair_query(rows):
    """What op12 returns, from (conv_id, turn, role, text) rows."""
    by = {}
    for c, t, r, x in damage(rows):
        by.setdefault(c, []).append((t, r, x))
    out = {}
    for c in {row[0] for row in rows}:
        got = sorted(by.get(c, []), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        turns = {t for t, _, _ in got if t is not None}
        found = repair_forward([(r, x) for _, r, x in got]) if got else {
            "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired": ""}
        found["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found["repaired_sha256"] = hashlib.sha256(found.pop("repaired").encode()).hexdigest()
        out[c] = found
    return out


# Prefix trie: every prefix as a tuple.
def trie(rows):
    """{(depth, prefix): stats} of op13 from (conv_id, turn, role, text) rows."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v, key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))] for c, v in convs.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        b = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(b, [])[:h] + turns[c][h:]
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = {}
    for p, members in nodes.items():
        children = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        out[p] = {"conv_id": min(members), "depth": len(p), "n_convs": len(members), "n_children": len(children)}
    for p in nodes:
        sub = [q for q in nodes if q[: len(p)] == p]
        out[p]["n_leaves"] = sum(out[q]["n_children"] == 0 for q in sub)
        out[p]["saved_tokens"] = sum((out[q]["n_convs"] - 1) * (len(q[-1][1].encode()) if q else 0) for q in sub)
        ends = sorted(c for c in nodes[p] if len(rebuilt[c]) == len(p))
        out[p]["ends_sha256"] = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out[p]["parent_conv_id"] = out[p[:-1]]["conv_id"] if p else None
    return out
