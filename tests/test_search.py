"""Set joins, substring search and name scores against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from priceloom.functions import scores
from priceloom.operators import postings, similarity


def sets_of(seed, n, words="abcdefghijklmnop", common="z"):
    rng = random.Random(seed)
    return {f"{seed}-{k}": sorted({rng.choice(words) * rng.randint(1, 3) for _ in range(rng.randint(1, 7))} | ({common} if rng.random() < 0.5 else set())) for k in range(n)}


def ordered(spark, left, right):
    frame = lambda sets, key: spark.createDataFrame(list(sets.items()) + [(None, ["a"])], f"{key} string, tokens array<string>")
    a, b = (frame(s, key).filter(F.col(key).isNotNull()) for s, key in ((left, "product_name"), (right, "name")))
    held = similarity.frequencies(a, b)
    return similarity.by_rarity(a, "product_name", held), similarity.by_rarity(b, "name", held)


@pytest.mark.parametrize("least", [0.0, 0.2, 0.34, 0.5, 0.6, 0.75, 1.0])
def test_overlapping_sets(spark, least):
    left, right = sets_of(1, 80), sets_of(2, 80)
    left["empty"] = []
    share = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in left.items() for b, y in right.items() if set(x) & set(y)}
    a, b = ordered(spark, left, right)
    got = [tuple(r) for r in similarity.overlapping(a, b, least).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(*p, round(s, 4)) for p, s in share.items() if s >= least - 1e-9}
    compared = similarity.met(a, b, least, ("product_name", "name")).select("product_name", "name").distinct().count()
    assert compared <= len(share) * {0.5: 0.5, 0.6: 0.3, 0.75: 0.15, 1.0: 0.1}.get(least, 1)


@pytest.mark.parametrize("levels", [similarity.LEVELS, (0.9, 0.0), (0.0,)])
def test_best_overlaps(spark, levels):
    rng = random.Random(3)
    words = ["w" + c * 2 for c in "abcdefghij"]
    made = lambda n: [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(n)]
    names, items = [*made(60), "", None, "nothing here", "Waa"], [(str(k * 7 % 101), n) for k, n in enumerate([*made(90), None, ""])] + [("5", "waa"), ("55", "WAA wbb")]
    items += [(str(1000 + k), "wcc") for k in range(20)]
    tokens = lambda n: {w for w in n.lower().split() if len(w) >= 2}
    want = set()
    for n in {n for n in names if n}:
        scored = []
        for i, m in {(i, m) for i, m in items if m}:
            if tokens(n) & tokens(m):
                scored.append((-round(len(tokens(n) & tokens(m)) / len(tokens(n) | tokens(m)), 4), len(i), i, m))
        want |= {(n, i, -s, k) for k, (s, _, i, m) in enumerate(sorted(scored)[:5], 1)}
    got = similarity.best_overlaps(spark.createDataFrame([(n,) for n in names], "product_name string"), spark.createDataFrame(items, "product_id string, name string"), levels=levels)
    rows = [(r.product_name, r.product_id, r.overlap, r.rank) for r in got.collect()]
    # An id with two names may take two ranks that tie in all but the name.
    assert {r[:3] for r in rows} == {r[:3] for r in want} and len(rows) == len(want)


@pytest.mark.parametrize(("common", "deep"), [(0, 8), (3, 2), (20, 0), (10**6, 8)])
def test_best_overlaps_by_classes(spark, common, deep):
    """Rare words, subsets of frequent words and classes of many frequent words give the same."""
    rng = random.Random(9)
    made = lambda n: [" ".join({rng.choice("abcdefgh") * rng.randint(2, 4) for _ in range(rng.randint(1, 6))}) for _ in range(n)]
    names, items = made(40), {(str(k), n) for k, n in enumerate(made(150))}
    want = set()
    for n in set(names):
        a = set(n.split())
        scored = sorted((-round(len(a & set(m.split())) / len(a | set(m.split())), 4), len(i), i, m) for i, m in items if a & set(m.split()))
        want |= {(n, i, m, -s, k) for k, (s, _, i, m) in enumerate(scored[:5], 1)}
    got = similarity.best_overlaps(spark.createDataFrame([(n,) for n in names], "product_name string"), spark.createDataFrame(list(items), "product_id string, name string"), common=common, deep=deep)
    assert {tuple(r) for r in got.collect()} == want


def test_best_overlaps_compare_few_pairs(spark):
    """Ten thousand names with a word in common: the names found by it alone are not listed."""
    items = spark.range(10_000).select(F.col("id").cast("string").alias("product_id"), F.format_string("brand x%05d y%03d", F.col("id"), F.col("id") % 500).alias("name"))
    names = items.filter("product_id % 10 = 0").select(F.col("name").alias("product_name"))
    right = similarity.token_sets(items, "name", F.split("name", " "))
    left = similarity.token_sets(names, "product_name", F.split("product_name", " "))
    held = similarity.frequencies(left, right)
    pairs = similarity.met(similarity.by_rarity(left, "product_name", held), similarity.by_rarity(right, "name", held), 0.5, ("product_name", "name")).count()
    assert pairs <= 25_000  # of ten million that share "brand"
    top = similarity.best_overlaps(names, items)
    assert top.filter("rank = 1 AND overlap = 1").count() == 1000 and top.count() == 5000


def test_contained_sets(spark):
    rng = random.Random(5)
    rows = {k: sorted({rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))}) for k in range(70)}
    targets = {k: sorted({rng.choice("abcdefghxy") for _ in range(rng.randint(0, 3))}) for k in range(40)}
    frame = lambda d, key: spark.createDataFrame([*d.items(), (None, ["a"]), (3, None)], f"{key} int, keys array<string>")
    got = [tuple(r) for r in similarity.containing(frame(rows, "row"), frame(targets, "target")).collect()]
    assert sorted(got) == sorted((r, t) for r, a in rows.items() for t, b in targets.items() if b and set(b) <= set(a))
    assert similarity.containing(frame({}, "row").limit(0), frame(targets, "target")).collect() == []


def test_contained_sets_of_all_sizes(spark):
    """Rows of few, some and many keys are asked for four, two and one key of a target at once."""
    rng = random.Random(8)
    rows = {k: sorted(rng.sample([f"k{n}" for n in range(60)], rng.choice([3, 8, 12, 13, 30, 40, 41, 55]))) for k in range(60)}
    targets = {k: sorted(rng.sample(rng.choice(list(rows.values())), rng.randint(1, 3))) for k in range(40)} | {k: rng.sample(rows[k], min(len(rows[k]), k)) for k in range(40, 60)}
    frame = lambda d, key: spark.createDataFrame(list(d.items()), f"{key} int, keys array<string>")
    found = similarity.containing(frame(rows, "row"), frame(targets, "target"))
    assert sorted(map(tuple, found.collect())) == sorted((r, t) for r, a in rows.items() for t, b in targets.items() if set(b) <= set(a))
    # Under one key alone all sets with a frequent key would meet; the joins are on arrays of keys.
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner, (" in line]
    assert joins and all("asked" in line for line in joins)


def test_equal_sets_meet_as_lists(spark, monkeypatch):
    """Pairs are made where lists of equal sets have met, and are not brought together again; keys with several sets give a pair once."""
    monkeypatch.setattr(similarity, "LISTED", 3, raising=False)
    rng = random.Random(9)
    frame = lambda d, key: spark.createDataFrame(d, f"{key} int, keys array<string>")
    for words in (8, 90):
        kinds = [sorted({f"k{rng.randrange(words)}" for _ in range(rng.randint(1, 8))}) for _ in range(12)]
        rows = [(k, rng.choice(kinds)) for k in range(150)]
        targets = [(k, rng.choice(kinds)[: rng.randint(1, 5)]) for k in range(80)] + [(90, ["k0", "no row has it"])]
        want = lambda: sorted({(r, t) for r, a in rows for t, b in targets if set(b) <= set(a)})
        found = similarity.containing(frame(rows, "row"), frame(targets, "target"))
        assert sorted(map(tuple, found.collect())) == want()
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
        rows, targets = [*rows, *((k % 9, kinds[k % 12]) for k in range(30))], [*targets, *((k % 7, kinds[k % 12]) for k in range(20))]
        assert sorted(map(tuple, similarity.containing(frame(rows, "row"), frame(targets, "target")).collect())) == want()


def test_names_that_hold_a_needle(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abAB-1 ") for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["100% wool_a", "İstanbul ß", "漢字かな"]
    needles = ["".join(rng.choice("abAB-1 ") for _ in range(rng.randint(1, 5))) for _ in range(80)] + ["0%", "l_a", "ß", "字か", "zzz", "", None, "a" * 40]
    items = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    for shortest in (1, 2, 3):
        got = postings.names_with(asked, postings.trigram_index(items, shortest), shortest)
        low = {n.lower() for n in needles if n and len(n) >= shortest}
        assert sorted(map(tuple, got.collect())) == sorted((n, m) for n in low for m in set(names) if n in m.lower())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_needles_meet_few_names(spark):
    """Codes of one kind have their runs of three characters in common with many names, and those of six with few."""
    items = spark.range(10_000, 13_000).select(F.concat(F.lit("PRO-"), "id", F.lit(" x 7")).alias("name"))
    asked = items.select(F.lower(F.element_at(F.split("name", " "), 1)).alias("needle"))
    size = {"longest": postings.LONG}
    index = postings.trigram_index(items, **size)
    met = postings.rarest_runs(asked, postings.frequencies(index), **size).join(index, "gram").count()
    assert postings.names_with(asked, index, **size).count() == 3000
    assert met == 3000


def test_names_that_hold_a_long_needle(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abA1 ") for _ in range(rng.randint(0, 24))) for _ in range(300)]
    needles = [n[k : k + rng.randint(3, 12)] for n in names for k in [rng.randint(0, 10)]] + ["aaaaaab", "b" * 30, None, ""]
    frame = lambda values, column: spark.createDataFrame([(v,) for v in values], f"{column} string")
    got = postings.names_with(frame(needles, "needle"), postings.trigram_index(frame(names, "name"), longest=postings.LONG), longest=postings.LONG)
    low = {n.lower() for n in needles if n and len(n) >= 3}
    assert sorted(map(tuple, got.collect())) == sorted((n, m) for n in low for m in set(names) if n in m.lower())


def test_ladder_looks_up_long_runs(spark):
    """What a search of the ladder meets is in proportion to what it finds: read from the rows its joins give."""
    looked = []
    holding = postings.holding

    def counted(rarest, index):
        looked.append(rarest.join(index, "gram").count())
        return holding(rarest, index)

    items = spark.range(10_000, 13_000).select(F.col("id").cast("string").alias("product_id"), F.concat(F.lit("PRO-"), "id", F.lit(" x 7")).alias("name"))
    names = spark.range(10_000, 13_000).select(F.concat(F.lit("pro-"), "id", F.lit("rev x 7")).alias("product_name"))
    postings.holding = counted
    try:
        found = postings.ladder(names, items)
    finally:
        postings.holding = holding
    assert found.groupBy("step", "found").count().collect() == [(3, 1, 3000)]
    assert sum(looked) <= 2 * 3000


def test_ladder(spark):
    items = [
        ("1", "Kingston Fury KF556C40 16GB"), ("2", "Kingston Fury KF556C36 32GB"), ("3", "Монитор Samsung LS24A336"), ("4", "Samsung LS27A336 monitor"),
        ("5", "Keenetic Hero 4G"), ("6", "Keenetic Runner 4G 2210"), ("7", "ASUS Prime B650"), ("8", None), ("9", "Keenetic Air"), ("10", "Bag Rivacase 8035"),
    ]
    names = ["[new] keenetic  air", "memory KF556C40BB", "zz LS24A336NH", "Keenetic 2210 box", "Rivacase 8035", None, "", "нет такого"]
    got = postings.ladder(spark.createDataFrame([(n,) for n in names], "product_name string"), spark.createDataFrame(items, "product_id string, name string"))
    rows = {(r.product_name, r.name): (r.step, r.found) for r in got.collect()}
    assert rows == {
        ("[new] keenetic  air", "Keenetic Air"): (1, 1),
        ("memory KF556C40BB", "Kingston Fury KF556C40 16GB"): (3, 1),
        ("memory KF556C40BB", "Kingston Fury KF556C36 32GB"): (3, 1),
        ("zz LS24A336NH", "Монитор Samsung LS24A336"): (4, 1),
        ("Keenetic 2210 box", "Keenetic Runner 4G 2210"): (2, 2),
        ("Keenetic 2210 box", "Keenetic Hero 4G"): (2, 1),
        ("Keenetic 2210 box", "Keenetic Air"): (2, 1),
        ("Rivacase 8035", "Bag Rivacase 8035"): (2, 2),
    }
    best = {r.product_name: r.name for r in postings.ranked(got, 1).collect()}
    assert best["Keenetic 2210 box"] == "Keenetic Runner 4G 2210"


@pytest.mark.parametrize(
    ("a", "b", "prefix", "head", "tokens", "whole"),
    [
        ("Samsung Galaxy A55 8/256", "Samsung Galaxy A55 blue", 0.75, 0.75, 2 / 3, 0.708),
        ("SSD Samsung 990", "Samsung 990 SSD", 0.0, 1.0, 1.0, 0.8),
        ("a", "Samsung", 0.0, 0.0, 0.0, 0.7),
        ("Ноутбук (90NR0LC1-M00A10)", "ASUS TUF (90NR0LC1-M00A10)", 0.0, 2 / 3, 1.0, 0.95),
        (None, "Samsung", 0.0, 0.0, 0.0, 0.7),
        ("x", " ", 0.0, 0.0, 0.0, 1.0),
    ],
)
def test_scores_of_names(spark, a, b, prefix, head, tokens, whole):
    x, y = F.col("a"), F.col("b")
    row = spark.createDataFrame([(a, b)], "a string, b string").select(scores.prefix_score(x, y), scores.head_score(x, y), scores.token_score(x, y), scores.id_score(x, y)).first()
    assert tuple(row) == pytest.approx((prefix, head, tokens, whole))


def test_sets_that_cannot_fit_do_not_meet(spark):
    """Sets of three with two frequent tokens in common are under 0.6: they don't meet under the second of these, not even to be judged."""
    rows = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    left = similarity.spread(rows.select(F.concat(F.lit("a"), "id").alias("product_name"), F.array(F.concat(F.lit("a"), "id"), F.lit("x"), F.lit("y")).alias("tokens")))
    right = similarity.spread(rows.select(F.concat(F.lit("b"), "id").alias("name"), F.array(F.concat(F.lit("b"), "id"), F.lit("x"), F.lit("y")).alias("tokens")))
    joined = similarity.met(left, right, 0.6, ("product_name", "name"))
    assert joined.count() == 0
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    # The join of the sets themselves is on sizes and places too, and has nothing left to judge.
    assert "b_size" in plan.splitlines()[1] and ">=" not in plan.splitlines()[1]


def test_the_index_of_a_small_table_is_not_broadcast(spark, tmp_path):
    """A table of few bytes has many grams: they are no broadcast, whatever Spark makes of the table's size."""
    from priceloom.plans import search
    from tests.conftest import SF

    plan = search.substring_join(spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    last = next(line for line in plan if "Join" in line)
    assert "SortMergeJoin" in last and "gram" in last


def test_names_with_articles_meet_those_with_the_same(spark):
    from priceloom.operators import ids, matcher, matching

    rows = spark.range(200).select("id", F.format_string("90NR.%04dA0.M0%d", F.col("id"), F.col("id") % 10).alias("article"))
    names = rows.select(F.concat(F.lit("Ноутбук ASUS "), "article").alias("product_name")).union(spark.createDataFrame([("ASUS laptop black",), ("Мышь",)], "product_name string"))
    items = rows.select(F.col("id").cast("string").alias("product_id"), F.concat(F.lit("ASUS laptop ("), "article", F.lit(")")).alias("name")).union(spark.createDataFrame([("a", "ASUS laptop"), ("b", None)], "product_id string, name string"))
    pairs = ids._pairs(names, items, 0.18)
    assert pairs.count() == 200 + 200 + 201  # same articles; names with an article and the item without; the name without
    every = matching.token_candidates(names, items).select("product_name", "product_id", "name")
    likely = lambda p: {tuple(r) for r in matcher.match_names(p, 0.18).select("product_name", "product_id", "name", "score").collect()}
    assert likely(pairs) == likely(every)


def test_numbers_of_computers_stay_numbers(spark, tmp_path):
    from priceloom.functions import models
    from priceloom.plans import search

    spark.createDataFrame([(k,) for k in (1, 130_000, 1_199_998, 7_199_998)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    for offered in (True, False):
        named = search._named(spark, str(tmp_path), offered).filter("kind = 1")
        assert named.count() == 4 and named.filter(models.pc_code(F.col("said")).isNull()).isEmpty()
