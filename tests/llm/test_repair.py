"""Conversation repair against a search over all edits, and odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from docketry.llm import queries, repair
from docketry.llm.tables import table

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def plain(rows):
    """conv_id -> the contract's columns; edits by a best-first search over (cost, audit)."""
    talks, found = {}, {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, said in talks.items():
        left = []
        for turn, role, text in said:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in left:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:], strict=False))
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, edits, i, state, told = heapq.heappop(heap)
            if i == len(left) and state in (0, 3):
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            moves = [(r, STEP[state, r[0]]) for r in ("user", "assistant") if (state, r[0]) in STEP]
            for role, to in moves:
                heapq.heappush(heap, (cost + 5, edits + "I", i, to, (*told, f"{role}:")))
            if i < len(left):
                _, role, text = left[i]
                heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state, told))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 * (faults[i] == "truncated")
                    if (state, role[:1]) in STEP:
                        heapq.heappush(heap, (cost + more, edits + "K", i + 1, STEP[state, role[:1]], (*told, f"{role}:{text}")))
                    for r, to in moves:
                        heapq.heappush(heap, (cost + more + 1, edits + "R", i + 1, to, (*told, f"{r}:{text}")))
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return found


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_repair_matches_a_search_over_all_edits(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_repair(spark, small)) == plain(rows)


@pytest.fixture(scope="module")
def odd():
    """Nulls in every column, ties, repeated rows, unknown and empty roles, blank texts, white space and a long conversation."""
    rnd = random.Random(11)
    roles, texts = ["user", "assistant", "system", "u", None, "tool", ""], ["a.", "b", "c!", "", None, "a.", "é?  ", " \t\n", "x" * 50_000 + "."]
    made = [(c, rnd.choice([None, 1, 2, 3, 4, 4, 9, -(2**62), 2**62]), rnd.choice(roles), rnd.choice(texts)) for c in [None, *range(90)] for _ in range(rnd.randint(1, 8))]
    return made + [(500, i, ["user", "assistant"][i % 2 if i % 7 else 0], f"x{i % 40}.") for i in range(2_500)]


def test_repair_of_odd_rows(spark, odd):
    df = spark.createDataFrame([(*r, "clash") for r in odd], SCHEMA)
    assert result(repair.repaired(df)) == plain(odd)
    assert repair.repaired(df.limit(0)).count() == 0


def test_a_long_conversation_in_pieces(spark, odd, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_BITS", 4)
    long = [r for r in odd if r[0] == 500]
    df = spark.createDataFrame([(*r, "clash") for r in long], SCHEMA)
    assert result(repair.repaired(df)) == plain(long)


def test_a_conversation_without_rows_after_damage(spark):
    gone = next(i for i in range(1_000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "hello.", "")], SCHEMA)
    assert result(repair.repaired(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_nodes_settle_ties_by_the_least_letter():
    assert repair.END == ((0, 10, 5, 0), " II ")
    user = repair.node("u", repair.END)
    assert user == ((2, 5, 1, 2), "DKRD")  # deleting a lone user row is cheaper than adding an answer, and after another one it becomes the answer
    assert repair.audit("ua", [repair.END, repair.node("a", repair.END), repair.node("u", repair.node("a", repair.END))]) == "KK"
