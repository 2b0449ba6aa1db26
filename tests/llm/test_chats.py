"""Chats against a brute force: ties, nulls, copies, snapshots, conversations of several chunks."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from priceloom.llm import chats

SCHEMA = "conv_id long, turn int, role string, text string"


def brute_force(turns, chunk=20_000):
    coded = lambda v: "-" if v is None else f"{len(v)}:{v}"
    mark = lambda t: hashlib.sha256((coded(t[1]) + coded(t[2])).encode()).hexdigest()[:32]
    convs = defaultdict(set)
    for conv, *t in turns:
        convs[(conv,) if conv is not None else (None, *t)].add(tuple(t))
    first = lambda v: (v is not None, v if v is not None else 0)
    lists = {c: [t[1:] for t in sorted(ts, key=lambda t: (first(t[0]), (t[1] is not None, t[1] or ""), mark(t)))] for c, ts in convs.items()}
    out = Counter()
    for c, own in lists.items():
        same = [d for d in lists if lists[d] == own]
        ids = sorted(d[0] for d in same if d[0] is not None)
        best = c[0] == ids[0] if ids else c == min(same, key=str)
        if best and not any(len(o) > len(own) and o[: len(own)] == own for o in lists.values()):
            for k in range(0, len(own), chunk if len(own) > chunk else len(own)):
                part = own[k : k + chunk] if len(own) > chunk else own
                out[c[0], k // chunk, len(own), len(same), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in part)] += 1
    return out


def test_the_longest_stay(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (None, 0, None, None), (None, 0, None, None), (None, 1, "user", "z"), (None, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, "assistant", None)]
    rows = spark.createDataFrame(turns, SCHEMA).withColumns({"mark": F.lit("m"), "k": F.lit(1), "a": F.lit("x"), "part": F.lit("p")})
    got = chats.chat_texts(rows)
    assert got.columns == ["conv_id", "part", "n_turns", "n_copies", "text"]
    assert Counter(map(tuple, got.collect())) == brute_force(turns)
    assert sorted((r.conv_id or -1, r.n_turns, r.n_copies) for r in got.collect()) == [(-1, 1, 1), (-1, 1, 1), (2, 2, 2), (4, 2, 1)]
    assert chats.chat_texts(rows.limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [3, 20_000])
def test_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(chats, "CHUNK", chunk)
    rng = random.Random(2)
    long = [(k // 2 if k > 3 else None, rng.choice(("user", "bot", None)), rng.choice((None, "", f"text {k}", "again"))) for k in range(60)]
    turns = [(conv, *t) for conv, n in ((1, 60), (2, 60), (3, 41), (4, 7), (5, 1), (None, 9)) for t in long[:n]]
    turns += [(6, *t) for t in long[1:]] + [(7, 0, "user", "x"), (7, 0, "user", "x")]
    rng.shuffle(turns)
    got = chats.chat_texts(spark.createDataFrame(turns, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute_force(turns, chunk)


def test_long_chats_finish(spark):
    """Two conversations of 40,000 turns, one of them a snapshot of the other."""
    rows = spark.range(80_000).selectExpr("id % 2 AS conv_id", "cast(id div 2 AS int) AS turn", "'user' AS role", "concat('t', id div 2) AS text")
    assert sorted((r.conv_id, r.part, r.n_turns, r.n_copies) for r in chats.chat_texts(rows.filter("conv_id = 0 OR turn < 39000")).collect()) == [(0, 0, 40_000, 1), (0, 1, 40_000, 1)]
