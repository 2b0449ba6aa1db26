"""Spelling variants against a brute force over all pairs."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from priceloom.llm import variants


def apart(a, b):
    """Whether exactly one inserted, deleted or replaced code point tells a from b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_force(counts):
    near = {w: [v for v in counts if apart(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def some_words(seed, n, letters="abé", shortest=5, longest=9, begin=""):
    rng = random.Random(seed)
    return {begin + "".join(rng.choice(letters) for _ in range(rng.randint(shortest, longest))): rng.choice((3, 3, 4, 7, 9, 20, 50)) for _ in range(n)}


def test_automaton_numbers_words_in_order():
    words = sorted(some_words(1, 400))
    automaton = variants.Automaton(words)
    assert len(automaton.next) < sum(map(len, words)) / 3 and automaton.holds[automaton.start] == len(words)
    for w in words[::7]:
        for exact in range(len(w) + 1):
            assert automaton.near(w, exact) == {k for k, v in enumerate(words) if apart(w, v) and v[:exact] == w[:exact] and apart(w[exact:], v[exact:])}
    assert variants.Automaton([]).near("abc", 0) == set()


@pytest.mark.parametrize("most", [1, 3, 40, 20_000])
def test_all_links(spark, most):
    """Words of few letters, words with one beginning or end, and a chain, in groups that are split, cut into blocks, or neither."""
    counts = some_words(2, 150) | some_words(3, 60, "abc", 3, 6, "prefixed") | {w[::-1]: n for w, n in some_words(4, 60, "abc", 3, 6, "dne").items()}
    counts |= {"q" * k + "wxyz" + "z" * k: 3 << k for k in range(3, 8)} | {"zzzzzz": 100, "zzzzz": 50, "zzzzzzz": 3, "𝒳abcd": 5, "abcd𝒳": 9}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in variants.spelling_variants(rows, most).collect()}
    assert got == brute_force(counts)


def test_roots_at_the_end_of_chains(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc", "bbccc"]
    rows = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    assert {r.root for r in variants.spelling_variants(rows).collect()} == {"bbccc"}


def test_damage(spark):
    texts = [(1, "Éa Straße x-ABC÷d ñandú"), (None, "Hello"), (2, None), (3, ""), (3, "漢字 ab1cd"), *[(k, "wordlike thing") for k in range(10, 400)]]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"run": F.lit("r"), "h": F.lit(1), "key": F.lit("k")})
    want = []
    for d, t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in low).split():
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            want.append(run[:k] + run[k + 1 :] if h % 97 == 0 else run)
    got = [r.key for r in variants.damaged_words(docs).collect()]
    assert sorted(got) == sorted(want) and len(set(want)) > 9
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.spelling_variants(empty).collect() == []
