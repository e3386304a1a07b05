"""op13 against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from siltstone.llm import conversation_repair as cr

ROLES = ["user", "assistant", "system", "tool", ""]


def least(rows):
    """(cost, audit) of the cheapest edits by Dijkstra over (rows taken, initials' state), least audit first."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, initials = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit
        state = (at, initials[:1] if len(initials) <= 1 else "+" + initials[-1])
        if state in done or not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        done.add(state)
        for x in "ua":
            heapq.heappush(queue, (cost + 5, audit + "I", at, initials + x))
        if at < len(rows):
            role, fault = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, initials))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, initials + role[:1]))
                for x in "ua":
                    heapq.heappush(queue, (cost + more + 1, audit + "R", at + 1, initials + x))
    return None


def brute(rows):
    """rows: (conv_id, turn, role, text) -> conv_id: the report."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = talks[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in talks.items():
        kept.sort()
        seen, faults = set(), []
        for _, _, role, text in kept:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for known, t, *_ in kept if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = least([(k[2], f) for k, f in zip(kept, faults, strict=True)])
        lines, at, now = [], 0, ""
        for edit in audit:
            role = "assistant" if now == "u" else "user"
            text = "" if edit == "I" else kept[at][3]
            role = kept[at][2] if edit == "K" else role
            at += edit != "I"
            if edit != "D":
                lines.append(f"{role}:{text}")
                now = role[:1] or now
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seen int, place int, phase int").repartition(3)
    got = cr.repair_report(cr.damage(df), "lost").collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in got}


def test_reports_equal_exhaustive_search(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(300):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 14])):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else rng.choice([*ROLES, None])
            text = rng.choice(["Yes.", "No?", "open", "", " \t", "a. b!", "é ", None, f"text {rng.random()}."])
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice([None, 0, turn - 1, turn + 3]), role, text, 0, 0, 0))
    rows += [(None, 1, "user", "hello.", 0, 0, 0), (None, 2, "assistant", "bye.", 0, 0, 0), (None, 2, "assistant", "bye.", 0, 0, 0)]
    want = brute([r[:4] for r in rows])
    got = report(spark, rows)
    assert got.keys() == want.keys()
    assert [(k, got[k], want[k]) for k in want if got[k] != want[k]] == []


def test_long_conversation_and_empty_table(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(ROLES[:3]), rng.choice(["A.", "B", ""]) + f" {t}.", 0, 0, 0) for t in range(2_000)]
    got = report(spark, rows)
    assert got == brute([r[:4] for r in rows])
    assert report(spark, []) == {}


def test_turns_are_the_repaired_conversation(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "There?"), (1, 3, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    turns = [(r["edit"], r["turn"], r["role"], r["text"]) for r in cr.repair_turns(rows).where("edit is not null").collect()]
    assert turns == [("D", 1, "user", "Hi."), ("K", 2, "user", "There?"), ("K", 3, "assistant", "Yes.")]
