"""Conversation repair against a brute force over all edits, and over strings where those are too many."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from priceloom.llm import repair

WORTH = re.compile(r"(s?(ua)+)?")
TEXTS = ["Yes.", "Yes.", "no", " \t", "", "Why?\n", "x" * 70 + "a!", "x" * 70 + "b", "   tail"]


def key(v):
    return (v is not None, v)


def prepared(turns):
    """Rows after damage by conversation, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in turns:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[conv].extend([(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    for rows in out.values():
        rows.sort(key=lambda r: (key(r[0]), r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def lines_of(rows, audit):
    """The repaired rows of an audit, its cost, or None if it is no repair."""
    left, out, cost, at = list(zip(rows, faults(rows), strict=True)), [], 0, ""
    for edit in audit:
        if edit == "I":
            role, text, cost = None, "", cost + 2
        else:
            (_, role, text), fault = left.pop(0)
            if edit == "D":
                cost += 3
                continue
            if fault in ("blank", "duplicate"):
                return None
            cost += (edit == "R") * 2 + (fault == "truncated")
        if edit != "K":
            role = "assistant" if at[-1:] == "u" else "user"
        if not role:
            return None
        at += role[0]
        out.append(f"{role}:{text}")
    return (cost, out) if WORTH.fullmatch(at) else None


def all_edits(rows):
    """The cheapest audit, ASCII-least, of all edits with at most two insertions in a row."""
    found = []
    for edits in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
            audit = "".join(g + e for g, e in zip(gaps, (*edits, ""), strict=True))
            got = lines_of(rows, audit)
            if got:
                found.append((got[0], audit))
    return min(found)


def by_strings(rows):
    """The same with one string for each state."""
    best = {"": (0, "")}
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    for (_, role, _), fault in zip(rows, faults(rows), strict=True):
        after = defaultdict(list)
        for state, (cost, audit) in best.items():
            for n in range(3):
                at = state
                for _ in range(n):
                    at = step[at]
                c, a = cost + 2 * n, audit + "I" * n
                after[at].append((c + 3, a + "D"))
                if fault not in ("blank", "duplicate"):
                    c += fault == "truncated"
                    if role[:1] and (role[0] == step[at] or (at == "" and role[0] == "s")):
                        after[role[0]].append((c, a + "K"))
                    after[step[at]].append((c + 2, a + "R"))
        best = {s: min(v) for s, v in after.items()}
    ends = {"": "", "a": "", "u": "I", "s": "II"}
    return min((c + 2 * len(ends[s]), a + ends[s]) for s, (c, a) in best.items())


def expected(turns, search):
    out = {}
    for conv, rows in prepared(turns).items():
        cost, audit = search(rows)
        same_cost, lines = lines_of(rows, audit)
        assert same_cost == cost
        numbers = [t for t, _, _ in rows if t is not None]
        kinds = faults(rows)
        initials = [r[:1] for _, r, _ in rows]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *(kinds.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_turns(seed, sizes):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "admin"]
    out = []
    for conv, n in sizes:
        out += [(conv, rng.choice([None, k, k, k, k // 2, 3 * k]), rng.choice(roles), rng.choice([*TEXTS, None, f"{k}.", f"{k}"])) for k in range(n)]
    rng.shuffle(out)
    return out


def found(spark, turns):
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"kind": F.lit("k"), "conv": F.lit(1), "mark": F.lit(2), "given": F.lit(3), "copy": F.lit(4)})
    got = repair.repair(repair.damaged(rows)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_all_edits_of_short_conversations(spark):
    turns = some_turns(1, [(k, k % 4 + 1) for k in range(60)] + [(None, 3)])
    small = {c: rows for c, rows in prepared(turns).items() if len(rows) <= 4}
    turns = [t for t in turns if t[0] in small]
    assert found(spark, turns) == expected(turns, all_edits) == expected(turns, by_strings)


@pytest.mark.parametrize("chunk", [3, 7, 20_000])
def test_long_conversations_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    turns = some_turns(2, [(1, 60), (2, 25), (3, 1), (4, 2), (None, 40), (-5, 9)]) + [(9, 1, "user", "same.")] * 30
    assert found(spark, turns) == expected(turns, by_strings)


def test_conversations_that_lose_all_rows(spark):
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert found(spark, [(conv, 0, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, []) == {}


def test_one_hot_conversation(spark):
    rows = spark.range(100_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id, '.') AS text", "true AS given")
    (got,) = repair.repair(rows).collect()
    text = "\n".join(f"{'assistant' if k % 2 else 'user'}:t{k}." for k in range(100_000))
    assert tuple(got) == (1, 0, 0, 0, 0, 0, 0, "K" * 100_000, hashlib.sha256(text.encode()).hexdigest())
