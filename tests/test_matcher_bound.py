"""The bound that keeps pairs from the likeness of texts."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from priceloom.operators import matcher

KINDS = "Клавиатура Мышь Наушники Кабель Корпус".split()
BRANDS = "Logitech Razer Sven Acer Baseus".split()
WORDS = "silent slim classic home deluxe winter office sound comfort кожаный тихий большой легкий".split()


def some_names(seed, n):
    rng = random.Random(seed)
    return [" ".join([rng.choice(KINDS), rng.choice(BRANDS), *rng.sample(WORDS, rng.randint(0, 5))]) for _ in range(n)]


def test_the_bound_is_never_too_low(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeабв -1") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", "a", "漢字", "𝒳y"]
    rows = [(rng.choice(texts), rng.choice(texts)) for _ in range(500)] + [("", ""), ("a", "")]
    frame = spark.createDataFrame(rows, "a string, b string")
    frame = frame.withColumns({"x": matcher.letters(F.col("a")), "y": matcher.letters(F.col("b"))})
    got = frame.select("a", "b", matcher.most_alike(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("most")).collect()
    exact = [SequenceMatcher(None, r.a, r.b).ratio() for r in got]
    assert all(r.most >= e - 1e-12 for r, e in zip(got, exact, strict=True))
    assert sum(r.most for r in got) < 0.9 * len(got)


def test_same_verdicts_with_and_without_the_bound(spark, monkeypatch):
    """Of the pairs that the rules leave open most don't reach the likeness of texts if only good scores are asked for."""
    pairs = spark.createDataFrame([(a, b) for a in some_names(2, 25) + ["", None] for b in some_names(3, 25) + ["Мышь Sven silent"]], "product_name string, name string").distinct()
    whole = {(r.product_name, r.name): tuple(r)[2:] for r in matcher.match_names(pairs).collect()}
    reached = []

    def counted(rows, *others):
        out = kept(rows, *others)
        reached.append((rows.count(), out.count()))
        return out

    kept = matcher.reachable
    monkeypatch.setattr(matcher, "reachable", counted)
    for least in (0.0, 0.5, 0.8):
        got = {(r.product_name, r.name): tuple(r)[2:] for r in matcher.match_names(pairs, least).collect()}
        assert got == {k: v for k, v in whole.items() if v[0] >= least}
    (every, all_), (_, some), (_, few) = reached
    assert every == all_ > 100 and few < some < every and few < every / 2
