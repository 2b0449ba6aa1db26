"""Decontamination against a brute force: odd item ids, many small blocks, clashing columns."""

import random
import re

import pytest

from priceloom.llm import decontaminate
from tests.conftest import SF


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_force(docs, items, width=10):
    windows = {}
    for item, text in items:
        words = split(text)
        n = min(width, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    out = []
    for _, text in docs:
        words, hit, found = split(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (own := windows.get(tuple(words[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((len(words), len(hit), sorted(found, key=str)))
    return out


@pytest.mark.parametrize("block_bytes, piece", [(4 << 20, "whole"), (300, "many")])
@pytest.mark.parametrize("kind", ["string", "long"])
def test_against_brute_force(spark, block_bytes, piece, kind):
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta omega Zeta eta 9 ñu".split())
    items = [(str(k) if kind == "string" else k, " ".join(word() for _ in range(rng.choice((0, 3, 9, 10, 11, 40, 200))))) for k in range(60)]
    items += [(None, items[5][1]), (None, "Alpha, BETA"), (items[7][0], items[9][1]), (items[3][0], None), (items[4][0], " .. ")]
    docs = []
    for k in range(80):
        source = rng.choice([t for _, t in items if t])
        docs.append((k, " ".join([*(word() for _ in range(rng.randint(0, 20))), *source.split()[rng.randint(0, 3) : 30]])))
    docs += [(90, None), (91, ""), (None, "alpha beta"), (None, "alpha beta"), (92, "alpha-BETA; " * 3000)]
    table = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], "doc_id long, text string, found string, row string, items string")
    bench = spark.createDataFrame([(i, t, "a", "b") for i, t in items], f"item_id {kind}, text string, row string, block string")
    got = decontaminate.find_overlaps(table, bench, block_bytes=block_bytes, shard_bytes=20_000).select("row.doc_id", "row.text", "found").collect()
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.text), []).append((r.found.n_words, sum(s["last"] - s["first"] for s in r.found["spans"]), sorted(r.found["items"], key=str)))
    for doc, (n, hit, found) in zip(docs, brute_force(docs, items), strict=True):
        assert have[doc][0] == (n, hit, sorted([None if i is None else str(i) for i in found], key=str))
    assert len(got) == len(docs)


def test_one_python_step_for_many_blocks(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    small = decontaminate.find_overlaps(docs, bench, block_bytes=400)
    assert small._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(small.select("row.doc_id", "found").collect(), key=str) == sorted(decontaminate.find_overlaps(docs, bench).select("row.doc_id", "found").collect(), key=str)


def test_pieces_overlap_by_a_window_less_one(spark):
    text = " ".join(f"w{k}" for k in range(500))
    rows = decontaminate.pieces(spark.createDataFrame([(1, text), (1, text), (2, None)], "item_id long, text string"), piece_bytes=100).collect()
    got = {tuple(r.text.split()[k : k + 10]) for r in rows for k in range(len(r.text.split()) - 9)}
    assert got == {tuple(f"w{j}" for j in range(k, k + 10)) for k in range(491)} and len(rows) > 10


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == 1
