"""Labels, spans and score of the licence scan against a brute force, and on wording of public licences."""

import random
from functools import lru_cache

import pyarrow as pa
import pytest

from priceloom.llm import licences as L

PHRASES = {"p q": "pq", "x y z": "xyz"}
TEMPLATES = (("one", "a b c d e f g h i j k l"), ("two", "a b c d x y z e f g a b c d h"), ("short", "m n o p q r"))


def matches(words):
    """End and length of each longest match (in any phrase or template) that the next word does not lengthen."""
    runs = [p.split() for p in PHRASES] + [t.split() for _, t in TEMPLATES]
    inside = lambda part: any(part == r[i : i + len(part)] for r in runs for i in range(len(r)))
    longest = [max((n for n in range(e + 1) if inside(words[e - n : e])), default=0) for e in range(1, len(words) + 1)]
    return [(e, n) for e, n in enumerate(longest, 1) if n >= L.LONG and (e == len(words) or longest[e] <= n)]


def best_share(words, template):
    """The largest share of the template that any chain covers: all chains are tried."""
    own = template.split()
    found = [(e, p, n) for e, n in matches(words) for p in range(n, len(own) + 1) if own[p - n : p] == words[e - n : e]]

    @lru_cache(None)
    def best(j):
        e, p, n = found[j]
        out = n
        for i in range(j):
            new = min(n, e - found[i][0], p - found[i][1])
            if new > 0 and e - new - found[i][0] <= L.GAP and p - new - found[i][1] <= L.SKIP and found[i][0] >= e - n - L.GAP:
                out = max(out, best(i) + new)
        return out

    return max((best(j) for j in range(len(found))), default=0) / len(own)


def test_against_all_chains():
    scanner, rng = L.Scanner(PHRASES, TEMPLATES), random.Random(5)
    texts = []
    for _ in range(400):
        words = []
        while len(words) < rng.randint(5, 40):
            run = rng.choice([t.split() for _, t in TEMPLATES])
            at = rng.randint(0, len(run) - 2)
            words += rng.choice((run[at : at + rng.randint(2, 9)], ["w"] * rng.randint(1, 14), [rng.choice("abcdefxyzmnopqr")]))
        texts.append(" ".join(words))
    for text, row in zip(texts, scanner.scan(pa.array(texts)), strict=True):
        words = text.split()
        base = {label for phrase, label in PHRASES.items() if f" {phrase} " in f" {text} "}
        shares = {(label, template): best_share(words, template) for label, template in TEMPLATES}
        covered = {label for (label, template), share in shares.items() if share >= (L.COVER if len(template.split()) > 2 * L.LONG else 1)}
        assert row["labels"] == ",".join(sorted(base | covered)), text
        assert row["score"] == pytest.approx(1.0 if base else max(shares.values())), text
        assert {s["label"] for s in row["spans"]} == covered
        assert all(0 <= s["first"] < s["last"] <= len(words) for s in row["spans"])


@pytest.mark.parametrize(
    "text, labels",
    [
        ("// SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: MIT", "mit"), ("Licensed under the zlib license.", "zlib"), ("Creative Commons Zero v1.0 Universal", "cc0"),
        ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software', "mit"),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "bsd"),
        ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache"),
        ("The software is described in this document, and the author is to be thanked for it.", ""), ("Permission to use the copy was granted without fee.", ""),
    ],
)
def test_wording(text, labels):
    assert L.Scanner().scan(pa.array([text]))[0]["labels"] == labels


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a", "b"), (1, "", "a", "b"), (None, "cc by", "a", "b"), (None, "cc by", "a", "b"), (2, "word " * 100_000 + "mit license", "a", "b")], "doc_id long, text string, labels string, score string")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in L.scan_licences(docs).collect())
    assert got == [(0, 2, 1, 0, "cc-by", 1.0), (0, 2, 1, 0, "cc-by", 1.0), (1, 0, 0, None, "", 0.0), (1, 0, 0, None, "", 0.0), (2, 100_002, 1, 100_000, "mit", 1.0)]
    assert L.scan_licences(docs.limit(0)).collect() == []
