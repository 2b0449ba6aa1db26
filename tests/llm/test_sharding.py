"""Shards hold their limit, whatever repeats; the directory agrees with a plain split."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from priceloom.llm import sharding


def plain(docs, limit):
    """The bucket of each document: as many leading bits as it takes."""
    of = lambda d, t: int(hashlib.md5(f"{'-' if d is None else d}:{'-' if t is None else hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    out, todo = {}, [("", [(of(*d), d) for d in docs])]
    while todo:
        name, rows = todo.pop()
        size = sum(len((d[1] or "").encode()) for _, d in rows)
        if size <= limit or len(rows) == 1 or len(name) == 60:
            out |= {d: (name or "*", len(name), size) for _, d in rows}
        else:
            for bit in "01":
                own = [r for r in rows if f"{r[0]:060b}"[len(name)] == bit]
                if own:
                    todo.append((name + bit, own))
    return out


def test_against_a_plain_split(spark):
    docs = [(k, "ab" * (k * 37 % 400)) for k in range(300)] + [(301, None), (None, ""), (None, "x"), (302, "ñ" * 900)]
    got = {(r.doc_id, r.bytes): (r.shard, r.depth, r.shard_bytes) for r in sharding.shards(spark.createDataFrame(docs, "doc_id long, text string"), 1000).collect()}
    assert got == {(d, len((t or "").encode())): v for (d, t), v in plain(docs, 1000).items()}


def test_pages_of_equal_rows_hold_the_limit(spark):
    rows = [(1, "a" * 40, "s", {"k": 1})] * 100 + [(1, "a" * 40, f"s{k}", {"k": k}) for k in range(60)] + [(2, "b" * 300, "s", None)] * 3 + [(3, "c" * 60, "s", None)] * 3 + [(None, "d" * 10, "s", {})] * 50 + [(4, None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,int>").withColumns({"row": F.lit("r"), "h": F.lit(1), "shard": F.lit("old"), "bytes": F.lit("b")})
    got = sharding.shard_rows(docs, 100).collect()
    key = lambda r: (r[0], r[1], r[2], str(r[3]))
    assert Counter(key((r.doc_id, r.text, r.source, r.tags)) for r in got) == Counter(map(key, rows))
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(len((r.text or "").encode()))
        assert r.row == "r" and r.bytes == "b"
    said = {r.shard: r.shard_bytes for r in got}
    for shard, sizes in held.items():
        assert sum(sizes) == said[shard] and (sum(sizes) <= 100 or len(sizes) == 1)
    assert sharding.shard_rows(docs.limit(0), 100).collect() == []


def test_directory_joined_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "ab" * (k * 37 % 400)) for k in range(300)], "doc_id long, text string")
    want = sorted(sharding.shards(docs, 1000).collect())
    monkeypatch.setattr(sharding, "SEND_ROWS", 0)
    assert sorted(sharding.shards(docs, 1000).collect()) == want
