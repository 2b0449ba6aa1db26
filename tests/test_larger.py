"""What keeps the work of queries in proportion to their tables, and that results stay the same."""

import json
import random

from pyspark.sql import functions as F

from priceloom.functions import category_rules, payloads
from priceloom.operators import catalog, consolidate, export, market, matching, review
from priceloom.sources import nested, tables
from priceloom.sources.tables import stored


def test_overlap_ids_against_brute_force(spark):
    """A product listed twice has its tokens once; frequent and rare tokens give the same as all pairs."""
    rng = random.Random(5)
    words = [c * 4 for c in "abcdefgh"]
    made = lambda n: [" ".join(dict.fromkeys(rng.choices(words, k=rng.randint(1, 4)))) for _ in range(n)]
    items = [(str(k), n) for k, n in enumerate(made(150))]
    items += items[:20]
    names = sorted(set(made(40)) | {"aaaa zzzz yyyy", "zzzz"})
    listed = dict(items)
    want = {}
    for name in names:
        mine = set(name.split())
        parts = sorted((-len(mine & set(n.split())) / len(mine), len(i), i) for i, n in listed.items() if mine & set(n.split()))
        if parts and -parts[0][0] >= 0.55:
            want[name] = parts[0][2]
    got = catalog.overlap_ids(spark.createDataFrame([(n,) for n in names], "product_name string"), spark.createDataFrame(items, "product_id string, name string"))
    assert {r.product_name: r.found_id for r in got.filter("token IS NULL").collect()} == want


def test_names_are_judged_without_their_ids(spark):
    """Pairs are of names however many ids a name has, and the best ids are those of all pairs."""
    items = spark.createDataFrame([(str(k), n) for n in ("red bolt", "blue bolt", "bolt") for k in range(500)] + [("7", "old bolt")], "product_id string, name string")
    names = spark.createDataFrame([("red bolt",), ("red bolt",), ("bolt x",)], "product_name string")
    pairs = matching.named_pairs(names, items)
    assert pairs.count() == 2 * 4
    assert matching.first_ids(items.union(items), 3).groupBy("name").count().filter("count > 3").isEmpty()
    every = review.replacements(matching.token_candidates(names, items).withColumnRenamed("overlap", "score"), 5)
    few = review.replacements(pairs.withColumnRenamed("overlap", "score"), 5, items)
    assert sorted(map(tuple, few.select(*every.columns).collect())) == sorted(map(tuple, every.collect()))


def test_peripherals_of_many_ids(spark):
    items = spark.createDataFrame([(str(k), n) for n in ("Мышь Logitech G102", "Мышь Logitech G103") for k in range(300)], "product_id string, name string")
    found = review.peripheral_candidates(spark.createDataFrame([("Мышь Logitech G102",)], "product_name string"), items).collect()
    assert sorted((r["rank"], r.product_id) for r in found) == [(1, "0"), (2, "1"), (3, "10"), (4, "100"), (5, "101")]


def test_category_reads_a_name_once(spark):
    rows = spark.createDataFrame([("[new] Мышь Razer",), ("",), (None,), ("Nothing known",)], "name string").select("name", category_rules.category(F.col("name")).alias("category"))
    assert {r.name: r.category for r in rows.collect()} == {"[new] Мышь Razer": "Мышь", "": "Без категории", None: "Без категории", "Nothing known": "NOTHING"}
    assert rows._jdf.queryExecution().analyzed().toString().count("дюйм ") <= 2


def test_offers_without_id_stay_spread(spark):
    """A join on the id doesn't bring all rows without one together, and loses none."""
    rows = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 4 == 0, (F.col("id") % 40).cast("string")).alias("product_id"), F.concat(F.lit("n"), "id").alias("product_name"), F.lit("s").alias("supplier"))
    stats = spark.createDataFrame([("0", 1.0), ("4", 2.0)], "product_id string, min_price double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (market.enrich(rows, stats), consolidate.drop_suppliers_of_repeated_ids(rows, F.col("product_id") == "0", F.col("product_name"))):
            assert found.filter("product_id IS NULL").select(F.spark_partition_id().alias("p")).distinct().count() > 1
        found = market.enrich(rows, stats)
        assert found.count() == 4000 and found.filter("min_price IS NOT NULL").count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_parts_of_payloads_are_written_once_in_some_levels(spark, monkeypatch):
    written = []
    monkeypatch.setattr(nested, "stored", lambda df: written.append(df.columns) or stored(df))
    deep = {"a": [{"b": {"c": [{"d": {"position_price": {"amount": "5"}}}, {"position_price": {"amount": "7,5"}}]}}]}
    rows = nested.amounts(spark.createDataFrame([("1", json.dumps(deep)), ("2", "[]"), ("3", "nonsense")], "product_id string, payload string"))
    assert sorted(map(tuple, rows.collect())) == [("1", 5.0), ("1", 7.5)]
    assert sum("node" in columns for columns in written) <= 4


def test_json_rows_are_read_at_once(spark):
    rows = [('{"price":"x","cost":{"byn":{"value":"4"}}}', 4.0, None), ('\t{"id":1.50,"pricePromo":" 3,5"}', 3.5, "1.5"), ('{"price":"{\\"amount\\":5}"}', None, None), ('[{"price":1,"id":2}]', None, None), ('{"price":NaN,"cost":2}', None, None)]
    given = spark.createDataFrame([(r,) for r, _, _ in rows], "row string")
    found = given.select("row", payloads.row_price(F.col("row")).alias("price"), payloads.row_id(F.col("row")).alias("id"))
    assert {tuple(r) for r in found.collect()} == set(rows)
    assert "get_json_object" not in given.select(payloads.row_id(F.col("row")))._jdf.queryExecution().analyzed().toString()


def test_report_is_worked_out_once(spark):
    rows = spark.createDataFrame([("s", "c", f"n{k % 3}", None, float(k), 1.0, k) for k in range(12)], "supplier string, category string, product_name string, product_id string, price double, rrp double, pos long")
    found = export.quality_samples(export.quality_report(rows), 2)
    assert {r.issue: r.n for r in found.collect()} == {"missing_id": 12, "price": 12, "duplicate": 12}
    assert "RDD" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_positions_are_read_once(spark):
    payload = {"positions": {"m": [{"shop_id": "1", "position_price": {"amount": "5,5", "converted": {"BYN": {"amount": "x"}}}}, {"shop_id": "1", "position_price": {"amount": "NaN"}}]}, "shops": {"1": {"title": "A"}}}
    found = tables.market_positions(spark.createDataFrame([("7", json.dumps(payload))], "product_id string, payload string"))
    assert [tuple(r) for r in found.collect()] == [("7", "A", 5.5)]
    assert not [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line and "regexp_replace" in line and "price" not in line.split("Filter")[0] and "size(" not in line]
