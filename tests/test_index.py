"""The kept index against the search over all names."""

import random

import pytest
from pyspark.sql import functions as F

from priceloom.operators import index, matching

WORDS = "widget widow wide small smart ring bolt rod gear cog fan hub".split()


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rng = random.Random(2)
    made = [(str(k), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9)))) for k in range(600)]
    items = spark.createDataFrame([*made, made[0], ("x", None), ("y", ""), ("z", "99 x Widget-Widget")], "product_id string, name string")
    folder = str(tmp_path_factory.mktemp("index"))
    index.write_index(items, folder)
    return items.filter("name IS NOT NULL").distinct(), folder


@pytest.mark.parametrize("words", [["Wid", "small"], ["ring"], ["wi", "x"], ["zzz", "bolt"], ["zzz"], [" "], [], ["wid", "sma", "ring", "bolt", "99"]])
@pytest.mark.parametrize("most", [5, 160])
def test_same_rows_as_the_search_over_all_names(spark, kept, words, most):
    items, folder = kept
    got = [tuple(r) for r in index.search(spark, folder, words, most).select("product_id", "name", "hits", "score").collect()]
    asked = [w for w in words if w.strip()]
    want = [tuple(r) for r in matching.search_any(items, asked, most).select("product_id", "name", "hits", "score").collect()] if asked else []
    assert got == want


def test_only_the_words_partitions_are_read_and_weak_postings_skipped(spark, kept):
    _, folder = kept
    every = index.lists(spark, folder, ["wid", "ring"])
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(head" in plan and {r.head for r in spark.read.parquet(f"{folder}/postings").select("head").distinct().collect()} > {"wi", "ri"}
    rows = {r.word: r for r in every.groupBy("word").agg(F.lit(10).alias("df"), F.count_distinct("token").alias("tokens")).collect()}
    weight = {"wid": 0.7, "ring": 1.5}
    few = index.candidates(every, rows, weight, 4.0)
    assert 0 < few.count() < every.select("product_id").distinct().count()
    assert "PushedFilters: [" in few._jdf.queryExecution().executedPlan().toString() and "GreaterThanOrEqual(gain" in few._jdf.queryExecution().executedPlan().toString()
