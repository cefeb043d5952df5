"""Conversation repair against an exhaustive search over edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from casebook.llm import conversations
from casebook.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, at int, audit string, row string, code int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)


def broken(rows):
    """Rows of one conversation after the damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if part == 0:
            continue
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        role = "user" if part == 4 else role
        parts = [conv, turn, role, hashlib.sha256(text.encode()).hexdigest()]
        row = "".join("-1:" if v is None else f"{len(str(v))}:{v}" for v in parts)
        row = hashlib.sha256(row.encode()).digest()
        out += [((turn is not None, turn or 0), role, text[:32], row, text, turn)] * (2 if part == 3 else 1)
    return [(turn, role, text) for _, role, _, _, text, turn in sorted(out)]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired) by Dijkstra over (row, state), taking the least (cost, audit)."""
    nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, kept
        if (i, state) in done:
            continue
        done.add((i, state))
        to = nexts[state]
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, kept + ((names[to], ""),)))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, kept))
            if found[i] in (None, "truncated"):
                more = 3 if found[i] else 0
                initial = role[:1]
                if initial == to or state == "" and initial == "s":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial, kept + ((role, text),)))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, kept + ((names[to], text),)))
    raise AssertionError


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = broken([r for r in rows if r[0] == conv])
        found = faults(own)
        cost, audit, kept = cheapest(own, found)
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)
    return out


def check(spark, rows):
    got = conversations.repair_report(frame(spark, rows)).collect()
    assert len(got) == len({r[0] for r in rows})
    want = expected(rows)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], (r, want[r.conv_id])


def made(rng, conv, n):
    texts = ["Yes.", "no", " \n", "", None, "Well!\n", "hm?", "long. text", "a.", "b.", "c.", "x" * 40 + "1.", "x" * 40 + "2."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "unknown"]
    return [(conv, rng.choice([i, i, i, i // 2, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {i}.") for i in range(n)]


def test_repair_equals_exhaustive_search(spark):
    rng = random.Random(3)
    rows = [r for conv in range(150) for r in made(rng, conv, rng.randint(1, 9))] + made(rng, None, 30) + made(rng, 999, 300)
    rng.shuffle(rows)
    check(spark, rows + rows[:200])


@pytest.mark.parametrize("passes", [0, 3])
def test_chunks_of_one_conversation_agree(spark, monkeypatch, passes):
    """Chunks of three rows: fix-up passes, and matrices where stretches of rows that must go never converge."""
    whole, used = conversations.repaired, []
    monkeypatch.setattr(conversations, "repaired", lambda rows: whole(rows, chunk=3, passes=passes))
    products = conversations._products
    monkeypatch.setattr(conversations, "_products", lambda m, towards: used.append(towards) or products(m, towards))
    rng = random.Random(passes)
    rows = made(rng, 1, 60) + made(rng, None, 25) + made(rng, 2, 4)
    rows += [(3, i, "user", None) for i in range(40)] + [(3, 50, "assistant", "end."), (4, 1, "tool", "a.")]
    rows += [(4, i, "tool", f"{i}.") for i in range(41)] + [(5, i, "user", f"cut {i}") for i in range(30)]
    check(spark, rows)
    assert 1 in used and -1 in used


def test_convergent_conversation_needs_no_matrix(spark, monkeypatch):
    whole = conversations.repaired
    monkeypatch.setattr(conversations, "repaired", lambda rows: whole(rows, chunk=4))
    products = conversations._products
    used = []
    monkeypatch.setattr(conversations, "_products", lambda m, towards: used.append(towards) or products(m, towards))
    check(spark, [(7, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(80)])
    assert 1 not in used


def test_all_rows_lost_and_no_rows(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    check(spark, [(lost, 1, "user", "Hello."), (5000, None, None, None)])
    assert conversations.repair_report(frame(spark, [])).count() == 0


def test_copies_of_one_row_are_counted_not_moved(spark):
    rows = [(1, 2, "user", "Same.")] * 400 + [(1, 3, "assistant", "Yes.")] + [(None, None, None, None)] * 300
    check(spark, rows)


def test_shared_table(spark):
    check(spark, [tuple(r)[:4] for r in table(spark, "/root/testdata/sf0.01", "conversations").collect()])
