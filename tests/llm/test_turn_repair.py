"""Conversation repair against a search over all edits, for damaged, null, tied and long conversations."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, gone string, kept string, again string"
SPACE = "\x20\t\n\x0b\x0c\r"


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        fill = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{fill(c)}:{fill(t)}".encode()) % 20
        role, text = fill(role), fill(text)
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[c] += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def flags(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def legal(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def search(rows, faults):
    """Cheapest edits by Dijkstra over (rows used, roles so far); audits compared as whole strings."""
    queue, best = [(0, "", 0, "", ())], {}
    while queue:
        cost, audit, i, roles, out = heapq.heappop(queue)
        if i == len(rows) and legal(roles):
            return cost, audit, out
        state = (i, roles[:1] == "s", len(roles) - (roles[:1] == "s") and roles[-1])
        if best.get(state, (cost, audit)) < (cost, audit):
            continue
        best[state] = (cost, audit)
        follow = lambda r: re.fullmatch("(s?(ua)*u?)?", roles + r) is not None
        for name in ("user", "assistant"):
            if follow(name[0]) and cost < 4 * len(rows) + 12:
                heapq.heappush(queue, (cost + 3, audit + "I", i, roles + name[0], (*out, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, roles, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] in ("s", "u", "a") and follow(role[0]):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, roles + role[0], (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if follow(name[0]):
                        heapq.heappush(queue, (cost + more + 3, audit + "R", i + 1, roles + name[0], (*out, f"{name}:{text}")))


def expected(conversations):
    out, after = {}, damaged(conversations)
    for c in {r[0] for r in conversations}:
        rows = sorted(after[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = flags(rows)
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = search(rows, faults)
        out[c] = (c, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n, seed=1):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", ""]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "Fine!\n", "é…", "One more. And", "word " * 3000 + "."]
    rows = []
    for c in range(n):
        for k in range(int(rng.integers(1, 9))):
            turn = None if rng.random() < 0.1 else int(k + rng.integers(0, 3))
            rows.append((None if c == 0 else c, turn, roles[rng.integers(0, len(roles))] if rng.random() < 0.4 else roles[k % 2], texts[rng.integers(0, len(texts))] if rng.random() < 0.5 else f"Line {k}."))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [2, 256])
def test_against_search(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair.repair, "__defaults__", (block,))
    rows = conversations(150)
    got = {r.conv_id: tuple(r) for r in turn_repair.audit_damaged(frame(spark, rows)).collect()}
    assert got == expected(rows)


def test_long_conversation_and_empty_table(spark):
    rows = [(5, k, ("user", "assistant", "user")[k % 3], f"Line {k}{'.' if k % 7 else ''}") for k in range(1500)]
    whole = turn_repair.repair(turn_repair.damage(frame(spark, rows)), block=10**6).collect()
    assert whole == turn_repair.repair(turn_repair.damage(frame(spark, rows))).collect()
    assert whole[0].cost > 0 and legal("".join(t.role[0] for t in whole[0].turns))
    assert turn_repair.audit_damaged(frame(spark, [])).count() == 0


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    out = turn_repair.audit_damaged(frame(spark, [(7, turn, "user", "Hello.")])).collect()
    assert list(map(tuple, out)) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
